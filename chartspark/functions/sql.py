"""The scalar rules as SQL functions, for users who write SQL.

Each function is a temporary SQL function whose body is the rendered column expression, so
Catalyst inlines it: there is no Python in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from chartspark.functions import clinical as C
from chartspark.functions import text as T

# name -> (parameters, return type, expression over the parameter columns)
FUNCTIONS = {
    "cs_normalize_name": ("x string", "string", lambda x: T.normalize_name(x)),
    "cs_normalize_display": ("x string", "string", lambda x: T.normalize_display(x)),
    "cs_normalize_ingredient": ("x string", "string", lambda x: T.normalize_ingredient(x)),
    "cs_normalize_dose_value": ("x string", "string", lambda x: T.normalize_dose_value(x)),
    "cs_dose_in_text": ("x string", "string", lambda x: T.dose_in_text(x)),
    "cs_canonical_tobacco": ("x string", "string", lambda x: T.canonical_tobacco(x)),
    "cs_normalize_code": ("system string, code string", "string", lambda s, c: T.normalize_code(s, c)),
    "cs_icd10_dotted": ("x string", "string", lambda x: T.icd10_dotted(x)),
    "cs_marker_polarity": ("x string", "string", lambda x: T.marker_polarity(x)),
    "cs_marker_family": ("x string", "string", lambda x: T.marker_family(x)),
    "cs_is_tumor_marker": ("x string", "boolean", lambda x: T.is_tumor_marker(x)),
    "cs_parse_onset_age": ("x string", "int", lambda x: T.parse_onset_age(x)),
    "cs_parse_integer": ("x string", "int", lambda x: T.parse_integer(x)),
    "cs_names_cancer": ("x string", "boolean", lambda x: C.names_cancer(x)),
    "cs_model_key": ("x string", "string", lambda x: T.model_key(x)),
    "cs_stable_id": ("x string", "string", lambda x: T.stable_id("id", x)),
}


def _body(spark: SparkSession, parameters: str, expression) -> str:
    """SQL text of an expression: Spark's own rendering of the analysed column."""
    names = [p.split()[0] for p in parameters.split(",")]
    column: Column = expression(*[F.col(n) for n in names])
    frame = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS STRING) AS {n}" for n in names)).select(column.alias("result"))
    plan = frame._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def register_functions(spark: SparkSession) -> list[str]:
    """Create every function in the session; returns their names."""
    for name, (parameters, returns, expression) in FUNCTIONS.items():
        body = _body(spark, parameters, expression)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)

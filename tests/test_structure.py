import json
import random

from pyspark.sql import functions as F

from chartspark.operators import json_tree, quality, structure

TEXTS = "id long, resource string"


def slow_tree(value, path="", parent=None, key=None):
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
    kind = kinds.get(type(value), "number")
    yield path, parent, key, kind
    if kind == "object":
        for k, v in value.items():
            yield from slow_tree(v, f"{path}.{k}" if path else k, path, k)
    if kind == "array":
        for i, v in enumerate(value):
            yield from slow_tree(v, f"{path}[{i}]", path)


def any_json(rng, depth):
    kind = rng.randrange(7) if depth else rng.randrange(4)
    if kind < 4:
        return rng.choice(["text", "", 'a "system": "b"', 1, 2.5, -3, True, False, None])
    if kind < 6:
        return {rng.choice(["code", "system", "reference", "a", "b c"]): any_json(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [any_json(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_flatten_has_every_element_at_any_depth(spark):
    rng = random.Random(3)
    values = [any_json(rng, 5) for _ in range(40)]
    deep = 1
    for k in range(25):
        deep = {"a": deep} if k % 2 else [deep]
    values.append(deep)
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(100, None), (101, "no json"), (102, '{"a": 1, "a": 2}')]
    found = json_tree.flatten(spark.createDataFrame(rows, TEXTS), "resource", ["id"]).collect()
    assert sorted((r["id"], r["path"], r["parent"] or "", r["key"] or "", r["kind"]) for r in found) == sorted(
        (i, path, parent or "", key or "", kind) for i, v in enumerate(values) for path, parent, key, kind in slow_tree(v)
    )
    assert {r["value"] for r in found if r["kind"] == "string"} <= {"text", "", 'a "system": "b"'}


def test_structure_finds_faults_at_their_paths(spark):
    good = {"resourceType": "Observation", "status": "final", "code": {"coding": [{"system": "http://loinc.org", "code": "1-8"}]}, "valueQuantity": {"value": 1.5, "unit": "mg"}, "effectiveDateTime": "2001-02"}
    cases = [
        (good, []),
        (good | {"status": None}, [("status", "required element is missing")]),
        (good | {"code": [good["code"]]}, [("code", "must be a single value")]),
        (good | {"code": "x"}, [("code", "must be an object")]),
        (good | {"category": {"text": "x"}}, [("category", "must be a list")]),
        (good | {"category": [{"text": 5}, {"coding": [{"userSelected": "yes", "kind": 1}]}]}, [("category.0.text", "must be a string"), ("category.1.coding.0.kind", "unknown element"), ("category.1.coding.0.userSelected", "must be a boolean")]),
        (good | {"valueInteger": 1}, [("valueQuantity or valueInteger", "only one of these may be there")]),
        (good | {"effectiveDateTime": "2001-13"}, [("effectiveDateTime", "is not a valid dateTime")]),
        (good | {"effectiveDateTime": "2001-12-01T10:00:00+01:00", "issued": "2001-12-01"}, [("issued", "is not a valid instant")]),
        (good | {"component": [{}]}, [("component.0.code", "required element is missing")]),
        ({"resourceType": "MedicationRequest", "status": "active", "intent": "order", "subject": {"reference": "Patient/1"}}, [("medicationCodeableConcept or medicationReference", "required element is missing")]),
        ({"resourceType": "Planet"}, [("resourceType", "unknown resource type: Planet")]),
        ({"a": 1}, [("resourceType", "missing resourceType")]),
        ([1], [("", "not a JSON object")]),
    ]
    rows = [(i, json.dumps(v)) for i, (v, _) in enumerate(cases)] + [(50, None), (51, "{"), (52, '{"resourceType": "Condition", "resourceType": "Condition"}')]
    found = sorted((r["id"], r["path"], r["message"]) for r in structure.validate_r4(spark.createDataFrame(rows, TEXTS)).collect())
    assert found == sorted([(i, *issue) for i, (_, issues) in enumerate(cases) for issue in issues] + [(i, "", "not a JSON object") for i in (50, 51, 52)])
    assert structure.validate_r4(spark.createDataFrame([], TEXTS)).count() == 0


def test_a_bundle_is_profiled_by_its_elements(spark):
    coding = lambda system: {"system": system, "code": "1"}
    rows = [
        (1, 1, json.dumps({"resourceType": "A", "x": [{"reference": "r1"}, {"reference": "r2"}], "code": {"coding": [coding("s1"), {"code": "2"}]}})),
        (1, 2, json.dumps({"resourceType": "A", "x": {"y": {"reference": "r1"}}, "text": '"system": "decoy", "reference": "decoy"', "deep": [[coding("s2")]], "i": {"system": "alone"}})),
        (1, 3, json.dumps({"resourceType": "B", "reference": 5})),
        (2, 1, "broken"),
    ]
    found = {r["bundle_id"]: r for r in quality.bundle_profile(spark.createDataFrame(rows, "bundle_id int, entry_pos int, resource string")).collect()}
    one, two = found[1], found[2]
    assert (one["n_entries"], one["n_targets"], one["n_codings"], one["systems"]) == (3, 2, 2, ["s1", "s2"])
    assert [tuple(x) for x in one["types"]] == [("A", 2), ("B", 1)]
    assert (two["n_entries"], two["n_targets"], two["n_codings"], two["systems"], [tuple(x) for x in two["types"]]) == (1, 0, 0, [], [(None, 1)])


def test_walk_goes_on_with_open_rows_alone(spark):
    seen = []

    def level(now):
        seen.append(now)
        return now.select("id", "depth", (F.col("depth") > len(seen)).alias("open"))

    start = spark.range(5).select("id", F.col("id").alias("depth"), F.lit(True).alias("open"))
    assert sorted(r["id"] for r in json_tree.walked(start, level).collect()) == [0, 1, 2, 3, 4]
    # Levels run two at a time; the third reads what two levels left open, not the closed rows again.
    assert sorted(r["id"] for r in seen[2].collect()) == [3, 4]


def test_bundle_profile_finds_all_depths_and_no_decoys(spark):
    rng = random.Random(5)
    values = [any_json(rng, 6) for _ in range(60)]
    rows = [(i % 3, i, json.dumps(v)) for i, v in enumerate(values)]

    def inside(v):
        yield v
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else []:
            yield from inside(x)

    found = {r["bundle_id"]: r for r in quality.bundle_profile(spark.createDataFrame(rows, "bundle_id int, entry_pos int, resource string")).collect()}
    for b in range(3):
        objects = [x for v in values[b::3] for x in inside(v) if isinstance(x, dict)]
        assert found[b]["n_targets"] == len({x["reference"] for x in objects if isinstance(x.get("reference"), str)})
        assert found[b]["n_codings"] == len([x for x in objects if "system" in x and "code" in x])

import json

from convolake.operators import nested

NEST = {"content": [{"type": "t", "parts": ["a", None, {"x": 1}, 5, ["q", {"y": 2}]]}, "s"], "m": {"content": {"a": 1}, "parts": "text"}, "a/b~c": {"parts": [{"x": 1}]}}
SCHEMA = "record_id bigint, payload string, node_path string"


def brute(value, path="", key=None, direct=False):
    """Every place of a block, by a plain walk."""
    if isinstance(value, dict):
        if direct and key in nested.BLOCK_KEYS:
            yield path
        for k, v in value.items():
            yield from brute(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}", k, True)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if direct and key in nested.BLOCK_KEYS and isinstance(v, (dict, str)):
                yield f"{path}/{i}"
            yield from brute(v, f"{path}/{i}")


def test_blocks_against_a_plain_walk(spark):
    payloads = [json.dumps(NEST), json.dumps([NEST, NEST]), '"content"', json.dumps({"content": []}), json.dumps({"parts": [{"content": [{"content": ["deep"]}]}]})]
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], SCHEMA)
    found = {(r.record_id, r.node_path) for r in nested.blocks(nested.occurrences(df)).collect()}
    assert found == {(i, path) for i, p in enumerate(payloads) for path in brute(json.loads(p))}


def test_damaged_and_repeated_payloads(spark):
    rows = [(1, None), (2, ""), (3, '{"content":["a"'), (4, '{"content":["a"]} x'), (5, '{"content":[NaN]}'), (6, '{"content":["a"]}'), (6, '{"content":["a"]}'), (6, '{"content":["a","b"]}'), (None, '{"parts":["z"]}')]
    df = spark.createDataFrame([(a, b, None) for a, b in rows], SCHEMA)
    found = sorted((r.record_id or 0, r.node_path) for r in nested.blocks(nested.occurrences(df)).select("record_id", "node_path").distinct().collect())
    assert found == [(0, "/parts/0"), (6, "/content/0"), (6, "/content/1")]
    assert nested.occurrences(df.limit(0)).count() == 0


def test_equal_subtrees_are_stored_once_and_can_be_put_together_again(spark):
    df = spark.createDataFrame([(1, json.dumps(NEST), None), (2, json.dumps({"z": {"x": 1.0, "é": "ü"}, "y": [NEST]}), None)], SCHEMA)
    nodes = nested.occurrences(df)
    stored = {r.node_hash: r.body for r in nested.objects(nodes).collect()}
    assert len(stored) < nodes.count() == nested.bridge(df).count()

    def build(node):
        def fill(v):
            if isinstance(v, dict) and set(v) == {"$node"}:
                return build(v["$node"])
            return {k: fill(x) for k, x in v.items()} if isinstance(v, dict) else [fill(x) for x in v] if isinstance(v, list) else v

        return fill(json.loads(stored[node]))

    roots = {r.record_id: r.root_hash for r in nodes.collect()}
    assert build(roots[1]) == NEST and build(roots[2])["y"] == [NEST]


def test_key_order_does_not_matter_and_depth_is_no_trouble():
    a, b = nested.nodes({"x": {"p": 1, "q": [2]}}), nested.nodes({"x": {"q": [2], "p": 1}})
    assert {n[7] for n in a} == {n[7] for n in b}
    deep = "{\"a\":" * 3000 + "[]" + "}" * 3000
    whole, value = nested.parse(deep)
    assert whole and len(nested.nodes(value)) == 3001


def test_numbers_keep_their_digits_and_repeats_go_before_the_nodes(spark):
    body = '{"content":[1e400,0.10000000000000000000000001,-0,' + "9" * 5000 + "]}"
    rows = [(1, body, "x"), (1, body, "y"), (1, " " + body, "z"), (1, '{"content":[1]}', None), (2, body, None), (3, "{", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = nested.bridge(df).collect()
    assert len(found) == len(set(found)) == 6 + 3 + 6
    values = {r.node_path: (r.kind, r.body) for r in nested.occurrences(df).where("record_id = 2").collect()}
    assert values["/content/0"] == ("number", "1e400") and values["/content/1"][1].endswith("0001") and len(values["/content/3"][1]) == 5000
    assert nested.bridge(df.limit(0)).count() == 0

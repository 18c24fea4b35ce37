import random

from convolake.llm import conversations as C

MSG, PART = "id string, session_id string, time_created bigint, data string, role string", "id string, message_id string, data string, text string"
T = 1_736_000_000_000


def m(mid, session, at, role="user", data=None, parent=None):
    body = data if data is not None else '{"role":"%s"%s}' % (role, f',"parentID":"{parent}"' if parent else "")
    return (mid, session, at, body, "clash")


def p(pid, mid, text="hello", kind="text"):
    return (pid, mid, '{"type":"%s","text":%s}' % (kind, "null" if text is None else '"%s"' % text), "clash")


GOOD = [m("a1", "good", T, "Human"), m("a2", "good", T // 1000 + 1, "MODEL", parent="a1"), m("a3", "good", T + 500, "system")]
BAD = {
    "assistant first": [m("b1", "assistant first", T, "assistant"), m("b2", "assistant first", T + 1, "user"), m("b3", "assistant first", T + 2, "ai")],
    "no reply": [m("c1", "no reply", T, "user")],
    "empty": [m("d1", "empty", T, "user"), m("d2", "empty", T + 1, "assistant")],
    "broken": [m("e1", "broken", T, "user"), m("e2", "broken", T + 1, "assistant"), m("e3", "broken", T + 2, data='{"role":"user"} x')],
    "null data": [m("f1", "null data", T, "user"), m("f2", "null data", T + 1, "assistant"), ("f3", "null data", T, None, "clash")],
    "no role": [m("g1", "no role", T, "user"), m("g2", "no role", T + 1, "assistant"), m("g3", "no role", T, data='{"role":null}')],
    "lost parent": [m("h1", "lost parent", T, "user"), m("h2", "lost parent", T + 1, "assistant", parent="a1")],
    "tie by id": [m("k2", "tie by id", T, "user"), m("k1", "tie by id", T, "assistant")],
}


def tables(spark):
    messages = [r for rows in [GOOD, GOOD[:1], *BAD.values()] for r in rows] + [m("z", None, T, "assistant")]
    parts = [p("p" + r[0], r[0]) for r in messages if r[1] != "empty"] + [p("q1", "a1", "second"), p("q1", "a1", "second"), p("q2", "d1", " 　"), p("q3", "d2", None), p("q4", "d2", "tool text", "tool"), p("q5", None), p("q6", "none")]
    return spark.createDataFrame(messages, MSG), spark.createDataFrame(parts, PART)


def test_dropped_and_kept(spark):
    messages, parts = tables(spark)
    assert {r.session_id for r in C.dropped(messages, parts).collect()} == set(BAD)
    turns = C.conversations(messages, parts).orderBy("turn_no", "part_id").collect()
    assert [(r.session_id, r.turn_no, r.role, r.message_id, r.text) for r in turns] == [("good", 1, "user", "a1", "hello"), ("good", 1, "user", "a1", "second"), ("good", 2, "assistant", "a2", "hello")]
    assert C.dropped(messages.limit(0), parts).count() == 0
    assert C.conversations(messages.limit(0), parts).count() == 0
    assert {r.session_id for r in C.dropped(messages, parts.limit(0)).collect()} == {"good", *BAD}


def test_functions_of_the_automaton():
    rng = random.Random(1)
    for _ in range(200):
        symbols = [rng.randrange(4) for _ in range(rng.randint(0, 8))]
        cut = rng.randint(0, len(symbols))
        halves = []
        for part in (symbols[:cut], symbols[cut:]):
            f = C.IDENTITY
            for s in part:
                f = C.THEN[f][s]
            halves.append(f)
        for start in range(4):
            state = start
            for s in symbols:
                state = C.STEP[s][state]
            assert halves[1] // 4 ** (halves[0] // 4**start % 4) % 4 == state


def test_a_session_over_many_partitions(spark):
    rows = [m(f"m{i:05d}", "big", T + i, "user" if i % 2 == 0 else "assistant") for i in range(2000)]
    messages = spark.createDataFrame(rows, MSG).repartition(8)
    parts = spark.createDataFrame([p(f"p{i}", f"m{i:05d}", str(i)) for i in range(2000)], PART)
    assert C.dropped(messages, parts).count() == 0
    turns = C.conversations(messages, parts).orderBy("turn_no").collect()
    assert [(r.turn_no, r.text) for r in turns] == [(i + 1, str(i)) for i in range(2000)]

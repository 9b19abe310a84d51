import random

import duckdb

from brindle.llm import chat


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role, text))
    seq = {c: [(r or "unknown", t or "") for _, r, t in sorted(x, key=lambda y: (y[0] is None, y[0] or 0, y[1] or "unknown"))] for c, x in convs.items()}
    out = []
    for c, s in seq.items():
        if any(len(o) > len(s) and o[: len(s)] == s for o in seq.values()):
            continue
        same = [k for k, o in seq.items() if o == s]
        if c == min(same, key=lambda k: (k is None, k or 0)):
            for g in range(0, len(s), chat.SEGMENT):
                part = s[g : g + chat.SEGMENT]
                out.append((c, g // chat.SEGMENT, len(s), len(same), len(part), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in part)))
    return sorted(out, key=str)


def sample():
    rng = random.Random(7)
    rows, c = [], 0
    for _ in range(60):
        full = [(i, "user" if i % 2 == 0 else "assistant", rng.choice(["hi", "yes", "", None, "text " * 5])) for i in range(rng.randint(1, 9))]
        for n in sorted(rng.sample(range(1, len(full) + 1), rng.randint(1, min(3, len(full))))):
            rows += [(c, *t) for t in full[:n]]
            c += 1
    rows += [(9000, i, "user", f"t{i}") for i in range(700)]
    rows += [(9001, i, "user", f"t{i}") for i in range(300)]
    rows += [(None, 0, "user", "alone"), (9002, None, "user", "late"), (9002, 4, None, "early"), (9003, -3, "user", "minus"), (9003, 2, "user", "plus")]
    return rows


def test_rows(spark):
    rows = sample()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int").repartition(5)
    got = sorted((tuple(r) for r in chat.render(df).collect()), key=str)
    assert got == brute(rows)
    assert chat.render(df.limit(0)).count() == 0


def test_order_matters(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "b"), (2, 1, "user", "a"), (2, 2, "user", "c"), (3, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in chat.maximal(chat.prefixes(chat.positions(df))).collect()} == {1, 2, 3}


def test_sql(spark, tmp_path):
    rows = [r for r in sample() if r[0] is not None and r[1] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert sorted(map(str, con.execute(chat.SQL).fetchall())) == sorted(map(str, brute(rows)))


def test_plan_is_native(spark, capsys):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    chat.render(df).explain()
    out = capsys.readouterr().out
    assert "SortMergeJoin" in out or "HashJoin" in out
    assert not any(w in out for w in ("Python", "Pandas", "ArrowEval"))


def test_most_rows_in_one_conversation(spark, monkeypatch):
    """Nine tenths of the turns have neither conversation nor number; many of them are equal."""
    monkeypatch.setattr(chat, "PIECE", 37)
    monkeypatch.setattr(chat, "STRETCH", 2)
    rng = random.Random(3)
    rows = [(None, None, rng.choice(["user", None]), "same")] * 500 + [(None, None, "user", f"t{i}") for i in range(400)] + [(i % 9, i // 9 * 100, "user", f"u{i // 9 * (i % 3)}") for i in range(100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got, want = chat.render(df).collect(), brute(rows)
    plain = sorted((tuple(r) for r in got if r.conv_id is not None), key=str)
    assert plain == [r for r in want if r[0] is not None] and plain
    # Equal turn numbers go by role and then by hash: the order of the nameless turns is free within a role.
    turns = lambda out: "".join(r[5] for r in sorted(out, key=lambda r: r[1])).split("<|im_end|>\n")
    mine, other = turns([r for r in got if r.conv_id is None]), turns([r for r in want if r[0] is None])
    assert [t.split("\n")[0] for t in mine] == [t.split("\n")[0] for t in other] and sorted(mine) == sorted(other)
    assert [(r.n_turns, r.n_copies) for r in got if r.conv_id is None] == [(900, 1)] * 15

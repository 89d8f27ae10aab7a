import random

from pyspark.sql import functions as F

from pledgetrace.llm import chats as c

TREE = "tree string, node int, parent int, role string, text string, score double, rank int"


def messages(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], TREE)


def read(spark, rows, best=1):
    out = c.conversations(messages(spark, rows), best)
    shown = out.select("tree", "leaf", "rank", c.read_turns(F.col("formatted")).alias("t"),
                       c.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans").collect()
    return sorted((r["tree"], r["rank"], r["leaf"], [tuple(t) for t in r["t"]], r["loss"], r) for r in shown)


def test_best_branches_of_trees(spark):
    rows = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "low", 0.1), ("a", 3, 1, "assistant", "high", 0.9),
            ("a", 4, 3, "user", "more", 0.0), ("a", 5, 4, "assistant", "end", 0.5), ("a", 6, 4, "assistant", "tie", 0.5),
            ("b", 1, 77, "system", "orphan", None), ("c", 1, 2, "user", "loop", 1.0), ("c", 2, 1, "user", "loop", 1.0), ("c", 3, 1, "user", "below", 1.0)]
    got = read(spark, rows, 2)
    assert [(t, k, leaf) for t, k, leaf, *_ in got] == [("a", 1, 5), ("a", 2, 6), ("b", 1, 1)]
    assert [x for _, x in got[0][3]] == ["q", "high", "more", "end"] and got[0][4] == "highend"
    assert got[0][5]["formatted"] == "[INST] q [/INST] high</s>[INST] more [/INST] end</s>"
    assert got[0][5]["loss_spans"][0] == (17, 21)
    assert read(spark, []) == []


def test_random_trees_against_a_plain_walk(spark):
    rng = random.Random(4)
    rows = []
    for tree in "xyz":
        for n in range(1, 41):
            rows.append((tree, n, rng.randrange(max(1, n - 6), n) if n > 1 else None, "user", f"m{n}", float(rng.randint(0, 3))))
    got = {(r[0], r[1]): [x for _, x in r[3]] for r in read(spark, rows, 3)}
    for tree in "xyz":
        own = {n: (p, s) for t, n, p, _, _, s in rows if t == tree}
        leaves = set(own) - {p for p, _ in own.values()}
        def path(n):
            return [] if n is None else path(own[n][0]) + [n]
        order = sorted(leaves, key=lambda n: (-sum(own[m][1] for m in path(n)), n))
        for k, leaf in enumerate(order[:3], 1):
            assert got[tree, k] == [f"m{m}" for m in path(leaf)]


NASTY = ["", " ", "\\", "\\1", "\\0", "a\\", "</s>[INST] ok [/INST]", "[IN[INST]ST] <s<s>>", "\n\n", " [/INST]", "[ROLE]x[/ROLE]", "<<SYS>>\\6",
         "é😀</s>", "[INST] ", "$1 (.*)"]


def test_nasty_texts_come_back(spark):
    rows, want = [], {}
    for i, text in enumerate(NASTY):
        for j, role in enumerate(["system", "user", "assistant", "tool", "[/ROLE]</s>", "assistant"]):
            rows.append((str(i), j + 1, j or None, role, text, None))
            want.setdefault(str(i), []).append((role, text))
    for tree, _, _, turns, loss, r in read(spark, rows):
        assert turns == want[tree] and loss == want[tree][2][1] * 2
        assert all(x not in r["formatted"].replace("[ROLE]", "").replace("[/ROLE]", "") for x in ["</s></s></s></s>"])


def test_plain_conversations(spark):
    rows = spark.createDataFrame([(1, 5, "assistant", "b", 0), (1, 2, "user", "a", 0), (1, 2, "user", "a", 0), (None, 1, None, None, 0), (2, None, "user", "n", 0)],
                                 "conv_id long, turn long, role string, text string, tree int")
    out = c.conversations(c.chain(rows)).select("tree", c.read_turns(F.col("formatted")).alias("t")).collect()
    assert {r["tree"]: [tuple(x) for x in r["t"]] for r in out} == {
        "1": [("user", "a"), ("user", "a"), ("assistant", "b")], "null": [("", "")], "2": [("user", "n")]}
    assert c.conversations(c.chain(rows.limit(0))).collect() == []


def test_a_long_chain_takes_few_joins(spark):
    rows = spark.range(1, 301).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    (r,) = c.conversations(c.chain(rows)).select(c.read_turns(F.col("formatted")).alias("t")).collect()
    assert [x["text"] for x in r["t"]] == [str(i) for i in range(1, 301)]

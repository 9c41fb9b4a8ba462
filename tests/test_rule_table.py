"""Rules as data, and exact windows, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from talus.functions import rules
from talus.operators import rule_table

WORDS = "data lab clinical trial press media grant budget python java mouse model cell soil".split()


def texts(r, n):
    return [" ".join(r.choice(WORDS) + r.choice(["", "s", ".", "-x"]) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", None, "\u017foil \u212a", "\u0130stanbul x", "\u0131stanbul", "İstanbul DATA\nlab"]


@pytest.mark.parametrize(
    "pattern,want",
    [("abc", {"abc"}), ("ab|cd", {"ab", "cd"}), ("ab?c", {"a"}), ("a(?:bc|de)f", {"bc", "de"}), ("(?:x|y*)", None), (r"\bdata\s+lab\b", {"data"}), ("[ab]c{2,3}", {"c"}), (".*", None), ("(abcd)?ef", {"ef"}), ("(?=abc)x", {"x"}), ("ÄBc", {"bc"})],
)
def test_needed_literals(pattern, want):
    got = rule_table.literals(pattern)
    assert got == (None if want is None else frozenset(want))


def test_rules_against_the_plain_loop(spark):
    r = random.Random(1)
    table = [(f"r{i % 70:02}", "|".join(rf"\b{r.choice(WORDS)}s?\W{{1,3}}{r.choice(WORDS)}" for _ in range(r.randint(1, 3)))) for i in range(80)]
    table += [("any", "."), ("empty", ""), ("long s", "soil"), ("k", "k"), (None, "x"), ("none", None), ("dot", "istanbul"), ("multi", r"data\nlab")]
    docs = list(enumerate(texts(r, 300)))
    df = spark.createDataFrame(docs, "id long, body string").withColumn("rules", F.lit("clash"))
    known = spark.createDataFrame(table, "rule string, pattern string")
    got = {x["id"]: x["rules"] for x in rule_table.match_rules(df.repartition(4), "id", "body", known).collect()}
    plain = {i: sorted({n for n, p in table if n and p is not None and re.search(p, t, re.I)}) if t is not None else [] for i, t in docs}
    assert {k: sorted(v) for k, v in got.items()} == plain
    assert rule_table.match_rules(df.limit(0), "id", "body", known).count() == 0
    assert {tuple(x["rules"]) for x in rule_table.match_rules(df, "id", "body", known.limit(0)).collect()} == {()}
    with pytest.raises(re.error):
        rule_table.match_rules(df, "id", "body", spark.createDataFrame([("bad", "(")], "rule string, pattern string"))


def test_windows_against_the_plain_loop(spark):
    r = random.Random(7)
    patterns, marker, chars = [r"\bdata\w*", r"mouse\W+model", "cell"], r"\b(?:press|grants?)\b", 20
    docs = list(enumerate(texts(r, 200)))

    def near(t):
        for p in patterns:
            for m in re.finditer(p, t):
                if re.search(marker, t[max(0, m.start() - chars) : min(len(t), m.end() + chars)]):
                    return True
        return False

    df = spark.createDataFrame(docs, "id long, body string")
    got = {x["id"]: (x["n"], [tuple(s) for s in x["s"]]) for x in df.select("id", rules.near_exact(F.col("body"), patterns, marker, chars).alias("n"), rules.spans(F.col("body"), patterns[0]).alias("s")).collect()}
    assert got == {i: (near(t or ""), [m.span() for m in re.finditer(patterns[0], t or "")]) for i, t in docs}
    assert 20 < sum(n for n, _ in got.values()) < 180

    groups = {"lab": ["lab", "cell", "mouse", "soil"], "code": ["python", "java"], "press": ["press", "media"]}
    gaps = rules.clustered_gaps(F.col("body"), groups, {"code": 2, "press": 1}, 3, F.col("id") % 2 == 0, marker, chars, {"press": "media.{0,30}press"})
    found = {x["id"]: x["g"] for x in df.select("id", gaps.alias("g")).collect()}
    for i, t in docs:
        t, want = t or "", []
        for label, ps in groups.items():
            close = any(re.search(marker, t[max(0, m.start() - chars) : m.end() + chars]) for p in ps for m in re.finditer(p, t))
            if sum(bool(re.search(p, t)) for p in ps) >= {"code": 2, "press": 1}.get(label, 3) and (i % 2 or close) and (label != "press" or re.search("media.{0,30}press", t)):
                want.append(label)
        assert found[i] == want, i


def test_words_held_reads_its_texts_once(spark):
    """As words or within words, in one pass over the texts, against a plain count; blocks give the same."""
    import random

    r = random.Random(8)
    some = ["".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(40)]
    items = [(i, r.sample(sorted(set(some)), r.randint(1, 12))) for i in range(12)] + [(98, [])]
    texts = [(i, " ".join(r.choice(some) for _ in range(r.randint(0, 40)))) for i in range(60)] + [(99, None)]
    made = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(texts, "k long, t string").mapInArrow(read, "k long, t string")
    asked = spark.createDataFrame(items, "i long, w array<string>")
    want = sorted((k, i, c) for k, t in texts for i, w in items if t and w and (c := sum(x in t for x in w) / len(w)) >= 0.6)
    assert want and sorted(map(tuple, rule_table.words_held(docs, "k", "t", asked, "i", "w", 0.6).collect())) == want
    assert made.value == len(texts)
    assert sorted(map(tuple, rule_table.words_held(docs, "k", "t", asked, "i", "w", 0.6, block=20).collect())) == want
    assert rule_table.words_held(docs, "k", "t", asked.limit(0), "i", "w", 0.6).count() == 0

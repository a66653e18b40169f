"""Typed frontmatter, text repair and accents against plain versions."""

import json
import re
import unicodedata

from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.sources import front

NOTE = """---
title: A: plain  title
quoted: "say \\"x\\""
single: 'it''s'
count: 007
rate: -1.50
zero: -0
on: true
none: null
tags:
  - first tag
  - "second: tag"
- 3
-   [1, "two", null]
stray line
  - not read
inline: [a, "b"]
json: {"a": [1, 2], "b": {"c": "d"}}
list: ["x, y", 'z']
empty:
spaced:   value with ends   
title: last one wins
a_b-c: ünï ☃ \\ back
---
body --- text
---
"""


def values(spark, *notes):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, raw string")
    return [{k: json.loads(v) for k, v in r.v.items()} for r in df.select("i", front.front_values(F.col("raw")).alias("v")).orderBy("i").collect()]


def test_values_and_lists(spark):
    (got,) = values(spark, NOTE)
    assert got == {
        "title": "last one wins", "quoted": 'say "x"', "single": "it''s", "count": 7, "rate": -1.5, "zero": 0, "on": True, "none": None, "tags": ["first tag", "second: tag", 3, [1, "two", None]],
        "inline": "[a, \"b\"]", "json": {"a": [1, 2], "b": {"c": "d"}}, "list": "[\"x, y\", 'z']", "empty": [], "spaced": "value with ends", "a_b-c": "ünï ☃ \\ back",
    }


def test_odd_blocks(spark):
    found = values(spark, None, "", "no block\nkey: v", "---\r\nkey: v\r\nl:\r\n- a\r\n---\r\nbody", "---\nopen: yes\nlist:\n - x", "---\n---\n", " ---\na: b\n---", "---\n- lone\nbad key: x\n---\n")
    assert found == [{}, {}, {}, {"key": "v", "l": ["a"]}, {"open": "yes", "list": ["x"]}, {}, {}, {}]


def test_round_trip(spark):
    held = {"t": "plain", "colon": "a: b", "num": "12", "truth": "true", "quote": 'a "q" \\', "lines": "a\nb", "sp": " x ", "e": "", "n": 1.5, "b": False, "none": None, "l": ["a", 1, ["b, c", {"k": "v: w"}], ""], "o": {"x": [1]}, "el": [], "uni": "é☃", "odd": "[a", "s": "'q'"}
    df = spark.createDataFrame([({k: json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in held.items()},)], "m map<string,string>")
    text_ = df.select(front.rendered(F.col("m")).alias("t")).first()["t"]
    assert "t: plain\n" in text_ and 'num: "12"\n' in text_ and text_.startswith("---\n") and text_.endswith("---\n")
    (got,) = values(spark, text_ + "\nbody")
    assert got == held
    lists = spark.createDataFrame([(text_,)], "raw string").select(*[front.front_texts(F.col("raw"), k).alias(k) for k in ("t", "el", "e", "none", "absent", "n")]).first()
    assert tuple(lists) == (["plain"], [], [], [], [], ["1.5"])


def test_accents_over_the_basic_plane(spark):
    every = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    rows = ["".join(every[i : i + 500]) for i in range(0, len(every), 500)] + [None, "", "plain", "ﬁ ½ Ångström ㎏"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = [r.f for r in df.select("i", text.fold_accents(F.col("t")).alias("f")).orderBy("i").collect()]
    plain = lambda t: t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert got == [plain(r) for r in rows]
    assert df.where("i = %d" % (len(rows) - 1)).select(text.slug(text.fold_accents(F.col("t"))).alias("s")).first().s == "fi-12-angstrom-kg"


def test_repair(spark):
    def plain(value):
        for broken, meant in text.MOJIBAKE:
            value = value.replace(broken, meant)
        lines = [re.sub(r"\s+", " ", x).strip() for x in value.replace("\0", " ").replace("\r", "").split("\n")]
        return "\n".join(x for x in lines if x).strip()

    samples = ["", "Â© 2020 â€” a\u0000b  \t c \r\n\n \n x â€œqâ€ â€¢", " \n\n", "a\n  b\t\n\n\n c", "plain"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    assert [r.x for r in df.select("i", text.tidy_lines(F.col("t")).alias("x")).orderBy("i").collect()] == [plain(s) for s in samples]

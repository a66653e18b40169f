"""Takeaways against a plain line-by-line version."""

import random
import re

from pyspark.sql import functions as F

from siltstone.operators import takeaways as T

PY = lambda repl: re.sub(r"\$(\d)", r"\\\1", repl)


def in_turn(text, rules):
    for pattern, repl in rules:
        text = re.sub(pattern, PY(repl), text)
    return text


def normalised(text):
    return in_turn(text or "", T.REPAIRS).strip(" ")


def clean(value):
    text = in_turn(normalised(in_turn(value or "", T.MARKUP)), T.LEADS).strip(" ")
    if not text or re.search("(?i)" + "|".join(T.IGNORED), text):
        return ""
    parts = re.findall(r"[^.!?]+[.!?]?", text) or [text]
    text = re.sub(T.TAIL, "", re.sub(r"\s+", " ", " ".join(parts[:2]))).strip(" ")
    return text if re.search(r"[.!?]$", text) else text + "."


def bullets(text, marks, stops=(), skips=()):
    """One line after the other, with the takeaway that is being read."""
    out, now = [], None
    for line in re.split(r"\r?\n", text or ""):
        line = line.strip()
        if not line or any(re.search(p, line, re.I) for p in stops):
            out, now = out + [now] * (now is not None), None
        elif any(re.search(p, line, re.I) for p in skips):
            continue
        elif re.match(rf"[{marks}]\s", line):
            out, now = out + [now] * (now is not None), re.sub(rf"^[{marks}]\s+", "", line)
        elif now is not None:
            now += " " + line
    return [c for c in map(clean, out + [now] * (now is not None)) if c]


def unique(values, limit):
    out = {}
    for v in filter(None, map(clean, values)):
        out.setdefault(v.lower(), v)
    return list(out.values())[:limit]


NOTE = """lead line
- First point is *made*. It goes on
  over a wrapped line. A third sentence
  - nested one with `code`

stray
* star bullet
continued
- Reviewed by someone
-
- see [[path/to|the note]] and [site](http://x)
```
- fenced line
```

- """ + "Alpha Beta Inc. rose (AB). Then Gamma Holdings fell"
TEXT = """Intro
• Rates rose. Summary of it
(+) sign line
went on   here
Chart 3: a caption
not in a bullet
- Bond supply is heavy â€“ so yields climb
Source: someone
• Next one ends
at page 12
• Positive (+) or Negative (-) Implications remain
Positive (+) or Negative (-) Implications
tail

Disclaimer: none
- last! really? yes"""


def column(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def odd_texts():
    random.seed(5)
    pieces = ["- ", "* ", "• ", "\n", "\n\n", "  ", "word", "A b. ", "page 4\n", "Sources: x\n", "(-) y\n", "Z Group ", "...", "?", "\r\n", "-", "**b** ", "_u_", "\t", "Summary "]
    return [None, "", " \n", NOTE, TEXT, "- " * 500, "- a\n" + "wrapped line\n" * 30_000] + ["".join(random.choices(pieces, k=random.randint(1, 40))) for _ in range(300)]


def test_bullets_and_sentences_equal_the_plain_version(spark):
    texts = odd_texts()
    assert column(spark, texts, T.markdown_bullets) == [bullets(t, "-*") for t in texts]
    assert column(spark, texts, T.text_bullets) == [bullets(normalised(t), "-*•", T.STOPS, T.SKIPS) for t in texts]
    whole = [re.sub(r"\s+", " ", re.sub(r"(?i)^Summary\s*", "", normalised(t))).strip(" ") for t in texts]
    assert column(spark, texts, T.sentences) == [[c for c in map(clean, re.findall(r"[^.!?]+[.!?]?", t)) if c][:4] for t in whole]


def test_examples(spark):
    (found,) = column(spark, [NOTE], T.markdown_bullets)
    assert found[0] == "First point is made. It goes on over a wrapped line." and found[1] == "nested one with code."
    assert "star bullet continued." in found and not any("Reviewed" in f for f in found)
    (found,) = column(spark, [TEXT], T.text_bullets)
    assert found[0] == "Rates rose. Summary of it went on here." and found[1] == "Bond supply is heavy - so yields climb." and found[-1] == "last! really?"


def test_digests_and_preferred(spark):
    body = "## Summary\nSummary Copper rose. Tin fell! And zinc?\n\n## What This Source Says\n- Own point\n- own POINT\n\n## Page Route\n- Page 3 shows yields\n"
    rows = [
        (1, "g", "T1", body, "research_note", "- Extracted point\n\nx", None), (2, "g", "T2", body, " Chartpack_or_Visual ", "- Extracted point", None), (3, "g", "T3", None, None, None, "An excerpt *of it*"),
        (4, "h", "T4 " * 90, "", "", "", ""), (5, "h", "T5", "## Page Route\n- Page 9 is here\n- page 10 too", None, None, None),
    ]
    notes = spark.createDataFrame(rows, "n int, topic string, title string, body string, document_class string, extracted_text string, excerpt string")
    found = T.digests(notes)
    got = {r.n: r for r in found.collect()}
    assert got[1].takeaways == ["Extracted point.", "Own point.", "Page 3 shows yields.", "Copper rose.", "Tin fell!"]
    assert got[2].takeaways == ["Own point.", "Page 3 shows yields.", "Copper rose.", "Tin fell!", "And zinc?"]
    assert got[3].takeaways == [] and got[3].summary == "An excerpt of it." and len(got[4].summary) == 180 and got[5].summary == "Page 9 is here."
    chosen = {r.topic: r.takeaways for r in T.preferred(found, "topic", "n").collect()}
    assert chosen == {"g": ["Extracted point.", "Own point.", "Copper rose."], "h": ["Page 9 is here.", "page 10 too."]}


def test_merging(spark):
    row = spark.createDataFrame([("a\n\nb \n \n\n a", None, "c\n\nb")], "x string, y string, z string").select(T.merged(F.col("x"), F.col("y"), F.col("z")).alias("m")).first()
    assert row.m == "a\n\nb\n\nc"
    rows = spark.createDataFrame([("k", 2, "b\n\nc"), ("k", 1, "a\n\nb\n\na"), ("l", 1, " \n "), (None, 1, "z")], "key string, n int, text string")
    assert {r.key: (r.text, r.n_blocks) for r in T.merged_notes(rows, "key", "n", "text").collect()} == {"k": ("a\n\nb\n\nc", 3), None: ("z", 1)}

"""What makes plans cheap changes none of them: texts read between their marks, rules behind gates, paragraphs cut beside the chunker."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from textloom import registry
from textloom.functions import chunk, normalize, text
from textloom.operators import paragraphs, plan

WORDS = (
    "Mr. Dr. etc. e.g. U.S. J. (J. Smith Jones smith the The and because, but; 3. 12. (4. no. No. fig. Fig. Jan. St. p.m. word. word? word! word… word.) word.\" “word.” ?! . .. ) \" » word.» 。 字。 5kg % $ - —"
    " a—b / = x, y; z: é Écrit 1,000 $5 I .5 .a (a [b] 'q' it's O'Neil Sun. sun. ß ½ Ⅳ a.b. a.b.c. i.e. vs. approx. yrs w/o 24/7 ~5 ≈ ±3 ™ Foo® 😀 ❤️ a​b http://x.y www.a.b a@b.cd [1] ... & *b* #1 #Tag @me YoY WWII World War II"
    " Henry VIII SaaS TL;DR AWS IQ 5% 3-4 $1,000 3½ 1/2 2020-01-02 3:30pm v1.2"
).split(" ")


def made(seed, n, gaps=(" ", " ", " ", "  ")):
    r = random.Random(seed)
    for _ in range(n):
        yield r.choice(("", " ")) + r.choice(gaps).join(r.choice(WORDS) for _ in range(r.randint(1, r.choice((3, 25, 120))))) + r.choice(("", " "))


def test_spans_of_spaced_texts_are_those_of_words():
    r = random.Random(2)
    for t in made(1, 4000):
        kind, fast = r.choice(("text", "heading")), r.random() < 0.5
        assert chunk.Spaced(t).spans(kind, fast) == chunk.Paragraph(t).spans(kind, fast)
        assert chunk.Spaced(t).spans(kind, fast) == chunk.chunk(t, kind, fast)


def test_gates_close_on_nothing_a_rule_finds():
    def plainly(t):
        for find, say in text._BEFORE:
            t = find.sub(say, t)
        t = text._PICTURES.sub("", t)
        digits = None
        for rule in normalize.RULES:
            # the one gate that decides: a percent sign or degree is read where a digit stands
            if rule.gate == "digit" and digits is None:
                digits = normalize._DIGIT.search(t) is not None
            if rule.gate != "digit" or digits:
                t = rule.find.sub(rule.say, t)
        for find, say in text._AFTER:
            t = find.sub(say, t)
        t = t.strip(" ")
        return t if not t or text.compiled(text.ENDED).search(t) else t + "."

    for t in made(3, 4000, (" ", "  ", "", "\n", " ")):
        assert text.speech_text(t) == plainly(t)


def test_plain_prose_meets_no_rule(monkeypatch):
    class Refusing:
        def sub(self, *_):
            raise AssertionError("a rule was tried")

    monkeypatch.setattr(normalize, "_GROUPS", [(is_open, [normalize.Rule("", "", Refusing(), "")]) for is_open, _ in normalize._GROUPS])
    monkeypatch.setattr(text, "_AFTER", [(Refusing(), "")])
    assert text.speech_text(" The reader went home, and the dogs slept; nobody asked why it was") == "The reader went home, and the dogs slept; nobody asked why it was."


def test_paragraphs_in_python_are_those_of_spark(spark):
    r = random.Random(4)
    rows = [(i, "".join(w + r.choice((" ", " ", "\n", "\n\n", " 　")) for w in t.split(" "))) for i, t in enumerate(made(5, 300))]
    rows += [(1000, None), (1001, ""), (1002, "No stop " * 90), (1003, "Short one. " * 70), (1004, "...... " * 200), (1005, "x" * 600 + "\n\n\n" + "y" * 12), (1006, ("a" * 299 + ".") * 4)]
    df = spark.createDataFrame(rows, "doc long, text string")
    arrays = df.withColumn("p", F.coalesce(paragraphs.paragraph_array(F.col("text")), F.array().cast("array<string>")))
    assert {i: list(p) for i, p in arrays.select("doc", "p").collect()} == {i: paragraphs.paragraph_list(t) for i, t in rows}
    structs = df.select("doc", F.transform(paragraphs.paragraph_array(F.col("text")), lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"))).alias("paragraphs"))
    assert sorted(map(tuple, plan.segments(df, "doc", "text", start_paragraph=0).collect())) == sorted(map(tuple, plan.segments(structs, "doc", start_paragraph=0).collect()))


def test_plan_cover_deals_out_no_text(spark, tmp_path):
    spark.createDataFrame([(i, f"Some text number {i} that is long enough to be read. " * 3) for i in range(40)], "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.queries()["plan_cover"](spark, str(tmp_path))
    assert found.filter("numbered AND summed AND said").count() == 40
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    below = tree[tree.index("Window") :].split("\n")
    project = next(line for line in below if "Project" in line)
    assert "AS solid" in project and "AS said" in project and "speech" not in project.split("Project")[1].split("AS said")[1]

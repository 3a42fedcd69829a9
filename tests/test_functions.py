"""Golden values of scalar functions."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chains, ids, native, scalars, scoring, text, vectors


def values(spark, fn, inputs, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {typ}")
    return [r.v for r in df.select("i", fn(F.col("x")).alias("v")).orderBy("i").collect()]


def test_white_space(spark):
    assert values(spark, text.normalize, [" A  b\t\nC ", None, "　"]) == ["a b c", "", ""]
    assert values(spark, text.strip, ["  a b "]) == ["a b"]


def test_query_tokens():
    assert text.topic_tokens("right efforts a") == ["right", "efforts"]
    assert text.query_tokens("What is the feature of beauty?") == ["feature", "beauty"]
    assert text.search_terms("feature of beauty") == ["feature of beauty", "feature", "beauty"]
    assert text.search_terms("smell of water", boost=True)[:2] == ["scent", "pool of water"]
    assert len(text.search_terms(" ".join(f"word{i}" for i in range(20)))) == 6


def test_small_strings(spark):
    assert values(spark, lambda c: text.truncate(c, 6), ["abcdef", "abcdefg"]) == ["abcdef", "abc..."]
    assert values(spark, lambda c: text.one_line(c, 5), ["a\tb", "a\nbcdef"]) == ["a b", "a ..."]
    assert values(spark, text.chat_probe, [" Hi  there!?. "]) == ["hi there"]
    assert values(spark, text.sanitize_answer, ["See Excerpt 3 here\n\n\n\nx ", "  "]) == ["See  here\n\nx", "  "]
    assert values(spark, text.drop_code_fence, ['```json\n{"a":1}\n```', " x "]) == ['{"a":1}', "x"]
    assert values(spark, text.repair_speech_errors, ["the Suta, nexus utah; end of the so"]) == [
        "the sutta, next sutta sutta; end of the sutta"
    ]
    assert values(spark, text.normalize_for_similarity, ["It’s  A-B, çé!"]) == ["it s a b çé"]
    assert values(spark, text.mask_triple_ids, ["1.2.3 and 4.5, 10.20.300x"]) == ["[id] and 4.5, [id]x"]
    assert values(spark, text.canon_opening, ["He said “x” Then go", 'a "b"', "plain"]) == ["Then go", '"b"', "plain"]
    assert values(spark, text.transcript_opening, [" 4.8.79 So  now"]) == ["So  now"]


def test_spoken_and_spaced_ids(spark):
    both = ["two point three point ten", "three point four point thirty six", "4.19 186", "2.4 0.6", "Four noble truths point"]
    assert values(spark, ids.write_out_ids, both) == ["2.3.10", "3.4.36", "4.19.186", "2.4 0.6", "Four noble truths point"]
    mixed = ["two point three point twenty one"]
    assert values(spark, ids.write_out_ids, mixed) == ["2.3.20 one"]
    assert values(spark, lambda c: ids.write_out_ids(c, strict_first=False), mixed) == ["2.3.21"]
    assert values(spark, ids.infer_id, ["intro 4.5 then 4.8.79", "only 3.7.", "x" * 560 + " 1.2.3", ""]) == ["4.8.79", "3.7", "", ""]


def test_id_grammar(spark):
    assert values(spark, ids.canon_id, ["4.8.79", "4.79", "11", "", None]) == ["an4.79", "an4.79", "an11", "", ""]
    assert values(spark, ids.book_from_record_id, ["11.16", "AN 1.2", None]) == [11, None, None]
    assert values(spark, ids.book_from_canon_id, ["AN7.4", "x"]) == [7, 0]
    assert values(spark, ids.book_from_filename, ["012 Book 1A talk.txt", "Book  11.txt", "no"]) == [1, 11, 0]
    assert values(spark, ids.is_first_book_file, ["Book 1A x", "Book 1 x", "Book 11A"]) == [True, False, False]
    assert values(spark, ids.file_order, ["an12.json", "AN3.JSON", "anx.json"]) == [12, 3, 999]
    assert values(spark, ids.is_transition_only, ["The next sutta is.", "next sura is", "the next sutta is 3"]) == [True, True, False]
    pairs = spark.createDataFrame(
        [("4.8.79", "so 4 . 8.79 here"), ("4.8.79", "the next sutta is"), ("2.3.10", "two point three point ten"), ("", "4")], "t string, c string"
    )
    got = [r.v for r in pairs.select(ids.text_supports_id("t", "c").alias("v")).collect()]
    assert got == [True, False, True, False]


def test_header_window(spark):
    tag = lambda c: ids.insert_headers(c, ids.ID3)
    assert values(spark, tag, ["a 1.2.3 b"]) == ["a \n\n### REFERENCE: AN 1.2.3\n\n1.2.3 b"]
    close = "1.2.3 4.5.6"  # both get a header: the window is the text before insertion
    assert values(spark, tag, [close])[0].count("### REFERENCE:") == 2
    for gap, expected in ((76, 1), (77, 2)):
        t = "### REFERENCE:" + "x" * gap + "4.5.6"
        assert values(spark, tag, [t])[0].count("### REFERENCE:") == expected


def test_lexical_score(spark):
    score = lambda q: (lambda c: scoring.lexical_score(c, q))
    assert values(spark, score("feature of beauty"), ["as a Feature of Beauty here"]) == [120]
    assert values(spark, score("alpha beta gamma"), ["alpha beta"]) == [13]
    assert values(spark, score("alpha beta"), ["alpha", None]) == [0, 0]


def topic_rows(spark, rows):
    ddl = "pos bigint, sutta_id string, sutta string, commentary string, chain struct<items:array<string>,count:int,is_ordered:boolean,category:string>"
    return spark.createDataFrame(rows, ddl)


def test_topic_scores_and_ranking(spark):
    from corpusloom.operators import topic as T

    def chain(cat, *items):
        return (list(items), len(items), True, cat)

    rows = topic_rows(spark, [(0, "10.13", "", "", chain("fetters", "ten fetters"))])
    assert T.score_rows(rows, "fetters").first().score == 265003.0
    rows = topic_rows(spark, [(0, "10.177", "On the transference of merit.", "", None)])
    assert T.score_rows(rows, "transference of merit").first().score == 323.0
    rows = topic_rows(spark, [(0, "1", "merit and merit", "", None)])
    assert T.score_rows(rows, "merit").first().score == pytest.approx(1.64)

    corpus = topic_rows(spark, [
        (0, "11.16", "x", "", chain("advantages_of_loving-kindness".replace("_", " "), "sleeps well")),
        (1, "8.1", "advantages of loving-kindness are many", "loving kindness loving kindness", chain("other", "loving-kindness advantages")),
        (2, "4.2.13", "x", "", chain("right efforts", "effort to prevent")),
        (3, "5.1", "right right right efforts efforts", "efforts right", chain("efforts", "some right")),
        (4, "10.31", "x", "", chain("objects of the training", "for the excellence of the saṅgha")),
        (5, "10.31", "objects of the training", "", None),
        (6, None, "fetters", "", None),
        (7, "", "fetters fetters", "", None),
    ])
    for q, first in (("advantages of loving kindness", "11.16"), ("right efforts", "4.2.13"), ("objects of the training", "10.31")):
        hits = T.topic_hits(corpus, q, 5).collect()
        assert hits[0].sutta_id == first
        keys = [h.sutta_id or "" for h in hits]
        assert len(keys) == len(set(keys)) <= 5
    assert [h.pos for h in T.topic_hits(corpus, "fetters", 5).collect()] == [7]
    assert T.topic_hits(corpus, "a", 5).count() == 0
    with pytest.raises(ValueError):
        T.topic_hits(corpus, "fetters", 11)


def test_topic_summary(spark):
    from corpusloom.operators import topic as T

    def hits(*chains):
        rows = topic_rows(spark, [(i, str(i), "", "", c) for i, c in enumerate(chains)])
        return rows.withColumn("category_match", F.lit(False)).withColumn("score", -F.col("pos").cast("double"))

    line = lambda h, q="q": T.topic_summary(h, q.ljust(2, "q")).first().bot_summary
    assert line(hits((["A", "a", "B"], 3, False, None))) == "BOT: qq (A, B)"
    assert line(hits(([], 0, False, None), None)) == "BOT: qq (no chain tags)"
    assert line(hits(*[(["x"], 1, False, f"c{i}") for i in range(7)])) == "BOT: qq (c0, c1, c2, c3, c4)"
    many = hits(([f"i{i}" for i in range(12)], 12, False, None), (["z1", "z2"], 2, False, None))
    assert line(many) == "BOT: qq (" + ", ".join(f"i{i}" for i in range(8)) + ")"
    assert line(hits().limit(0)) == "BOT: qq (no matches)"
    assert T.topic_summary(hits(), "a").first().bot_summary == "BOT: a (enter a topic)"


def test_chain_helpers(spark):
    ddl = "struct<items:array<string>,count:int,is_ordered:boolean,category:string>"
    df = spark.createDataFrame([(((["x" * 90, 'é"'], 2, True, "right_effort")),), ((["y" * 90], 1, False, None),), (([], 0, False, ""),)], f"c {ddl}")
    c = F.col("c")
    rows = df.select(
        chains.column_title(c["category"], c["items"]).alias("t"), chains.chain_display(c["items"], c["is_ordered"]).alias("d"),
        chains.chain_json(c).alias("j"),
    ).collect()
    assert rows[0].t == "right effort" and rows[1].t == "y" * 80 + "…" and rows[2].t == "Chain"
    assert rows[0].d == "x" * 90 + ' → é"' and rows[2].d == ""
    want = {"items": ["x" * 90, 'é"'], "count": 2, "is_ordered": True, "category": "right_effort"}
    assert rows[0].j == json.dumps(want, ensure_ascii=False)


def test_similarity(spark):
    a, b = ("the quick brown fox " * 16)[:320], ("the quick brown fax " * 16)[:320]
    df = spark.createDataFrame([(a, b), ("seven powers faith energy", "the seven powers of faith")], "a string, b string")
    rows = df.select(native.sequence_ratio(F.col("a"), F.col("b")).alias("r"), scoring.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert round(rows[0].r, 3) == 0.053
    assert rows[1].j == 0.5
    assert values(spark, scoring.alignment_words, ["Doṇa <j>Sutta, É!"]) == ["dona sutta e"]
    assert [r for r in values(spark, scoring.quality_class, [0.2, 0.15, 0.05], "double")] == ["ok", "suspect", "bad"]
    assert values(spark, scoring.quality_reason, [0.25], "double") == ["agreement_score=0.250>=0.2"]


def test_small_talk(spark):
    said = ["hi there!", "whats up", "how are you?", "what is jhana", "thanks 2", "ok so", "", "good", "thanks a lot", "hi? there"]
    assert values(spark, scoring.is_small_talk, said) == [True, True, False, False, False, True, False, True, True, False]


def test_times_roles_uuids(spark):
    at = values(spark, scalars.micros, ["2026-04-09T07:11:34.833912Z", "bad", None])
    assert abs(at[0] - 1775718694833912) <= 1 and at[1:] == [0, 0]
    assert values(spark, scalars.role_from_sender, [" Human ", "ASSISTANT", "bot", None]) == ["user", "assistant", None, None]
    u = "11111111-1111-4111-8111-11111111111A"
    assert values(spark, scalars.canonical_uuid, [u, "{" + u + "}", u.replace("-", ""), "urn:uuid:" + u, "x"]) == [u.lower()] * 4 + [None]
    assert values(spark, lambda c: scalars.numbered_name(c, F.lit('a/b: "c"')), ["7", "x", "1234"]) == ["007_ab c", "000_ab c", "1234_ab c"]


def test_reply_parsing(spark):
    got = values(spark, scalars.reply_and_suggestions, ['text SUGGESTIONS_JSON: ["a","b"]', "t SUGGESTIONS_JSON: [oops", "plain", "t SUGGESTIONS_JSON:", 't SUGGESTIONS_JSON: {"a":1}'])
    assert [(g.reply, g.suggestions) for g in got] == [
        ("text", ["a", "b"]), ("t SUGGESTIONS_JSON: [oops", []), ("plain", []), ("t", []), ('t SUGGESTIONS_JSON: {"a":1}', []),
    ]
    many = json.dumps(["s%d" % i for i in range(8)] + ["x" * 400])
    assert len(values(spark, scalars.reply_and_suggestions, ["r SUGGESTIONS_JSON: " + many])[0].suggestions) == 5
    assert values(spark, scalars.starter_questions, ['```json\n{"questions":["a ", 3, "b"]}\n```', "[1]", "no"]) == [["a", "b"], [], []]
    salv = values(spark, lambda c: scalars.salvage_object(c, "a int"), ['{"a":1}', 'so {"a":2} end', "none", "[1]"])
    assert [s.a if s else None for s in salv] == [1, 2, None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([], [1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.cosine_distance("a", "b").alias("c"), native.distance_to(F.col("a"), [0.0, 2.0]).alias("d")).collect()
    assert [r.c for r in rows] == [1.0, 1e9, 1e9, 1e9, 1e9]
    assert [r.d for r in rows] == [1.0, 1e9, 1e9, 1e9, 1e9]
    l2 = df.select(native.distance_to(F.col("a"), [0.0, 2.0], "l2").alias("d")).collect()
    assert [r.d for r in l2] == [5.0, 1e9, 1e9, 4.0, 1e9]
    assert [r.u for r in df.select(vectors.usable_vector("a").alias("u")).collect()] == [True, False, True, True, False]


def test_mapping_status(spark):
    def status(conf=0.95, best=("an7.4",), evidence=("seven powers mindfulness",), mixed=False, kind="exact", primary=None):
        from corpusloom.operators.mapping import assign_status

        ddl = "best_canon_ids array<string>, primary_canon_id string, confidence double, is_mixed boolean, needs_review boolean, evidence_phrases array<string>, reason string, match_type string"
        row = spark.createDataFrame([(list(best), primary, conf, mixed, False, list(evidence), None, kind)], ddl)
        r = assign_status(row).first()
        assert r.needs_review == (r.status != "accept")
        return r

    ok = status()
    assert (ok.status, ok.primary_canon_id) == ("accept", "an7.4")
    assert status(conf=0.80).status == "accept_with_flag"
    for bad in (dict(mixed=True), dict(evidence=()), dict(kind="weird"), dict(best=()), dict(conf=0.5), dict(evidence=("the", "of it"))):
        assert status(**bad).status == "needs_review"

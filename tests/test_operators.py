"""Operators against brute force on small fixtures, and their invariants."""

import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import conversations as C
from corpusloom.functions.native import chunk_spans
from corpusloom.functions.sequences import Bounds, Prepared, Texts, ratio
from corpusloom.operators import answers as A
from corpusloom.operators import alignment as Al
from corpusloom.operators import chunking, dedup, mapping, models, ordered, records, retrieval, segments, subtitles


def test_chunk_lengths():
    lengths = lambda t: [b - a for a, b in chunk_spans(t)]
    assert lengths("a" * 1598 + ". ") == [1600, 400]
    assert lengths("a" * 2000) == [1500, 900]
    assert lengths("a" * 1500) == [1500]
    assert lengths("") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", min_size=1, max_size=6000))
def test_chunks_cover_text(t):
    spans = list(chunk_spans(t))
    if not spans:
        assert not t.strip()
        return
    starts = [a for a, _ in spans]
    assert starts[0] == 0
    assert all(b - a >= 351 for a, b in zip(starts, starts[1:]))
    end = 0
    for a, b in spans:
        assert a <= end or end == 0
        end = max(end, b)
    assert t[end:].strip() == ""


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabbcdefgh ", max_size=420), st.text(alphabet="aabbcdefgh ", max_size=420), st.floats(0, 1))
def test_ratio_equals_the_standard_library(a, b, floor):
    from collections import Counter

    want = difflib.SequenceMatcher(None, a, b).ratio()
    assert ratio(a, Prepared(b)) == want
    cut = ratio(a, Prepared(b), floor, Counter(a))
    assert cut == want if want >= floor else cut in (None, want)


def test_chunk_numbers_equal_a_global_row_number(spark):
    rng = random.Random(3)
    docs = [(i * 3 + rng.randint(0, 2), "word. " * rng.randint(0, 900)) for i in range(300)]
    df = spark.createDataFrame(docs, "o bigint, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chunking.number_chunks(df, "o").orderBy("o", "chunk_index").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.global_chunk_index for r in got] == list(range(len(got)))


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_neighbours_across_blocks(spark, block):
    rng = random.Random(block)
    rows = []
    for g in "ab":
        at = 0
        for _ in range(120 if g == "a" else 7):
            at += rng.choice([1, 1, 1, 9, 40])
            rows.append((g, at, rng.choice("xy")))
    df = spark.createDataFrame(rows, "g string, o bigint, v string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(block, 16)))
    try:
        assert ordered._in_order(df, ["g", "o"]).select("_part").distinct().count() > 1
        prev = {(r.g, r.o): r.p for r in ordered.with_previous(df, ["g"], "o", ["o", "v"], "p").collect()}
        nxt = {(r.g, r.o): r.n for r in ordered.with_next(df, ["g"], "o", ["o", "v"], "n").collect()}
        kept = sorted((r.g, r.o, r.v) for r in ordered.drop_consecutive(df, ["g"], "o", ["v"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = []
    for g in "ab":
        mine = [r for r in rows if r[0] == g]
        for i, (_, o, v) in enumerate(mine):
            p, n = prev[(g, o)], nxt[(g, o)]
            assert (p and (p.o, p.v)) == (mine[i - 1][1:] if i else None)
            assert (n and (n.o, n.v)) == (mine[i + 1][1:] if i + 1 < len(mine) else None)
            if not i or mine[i - 1][2] != v:
                expected.append((g, o, v))
    assert kept == sorted(expected)


def test_keep_first_is_idempotent(spark):
    df = spark.createDataFrame([("s", "a" * 300 + str(i % 2), i) for i in range(20)] + [("t", "x", 99)], "source string, text string, pos int")
    once = dedup.keep_first(df, dedup.prefix_key(200, "source"), ["pos"])
    twice = dedup.keep_first(once, dedup.prefix_key(200, "source"), ["pos"])
    assert sorted(r.pos for r in once.collect()) == sorted(r.pos for r in twice.collect()) == [0, 99]


def test_rank_filters_are_limited_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = dedup.top_per_key(df, ["k"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


RECORDS_DDL = (
    "rec_i bigint, pos bigint, suttaid string, sutta_id string, sutta string, commentary string, commentry string,"
    " commentary_id string, chain struct<items:array<string>,count:int,is_ordered:boolean,category:string>"
)


def test_record_documents(spark):
    rows = spark.createDataFrame(
        [
            (0, 0, " AN 1.1 ", None, "s", None, None, None, None),
            (1, 1, "AN 1.2", None, " ", None, "c", "cc", ([" one ", "two"], 2, True, "x")),
            (2, 2, "AN 1.3", None, None, None, None, None, None),
            (3, 3, "", None, "s", "c", None, None, None),
        ],
        RECORDS_DDL,
    )
    got = {}
    for r in records.to_documents(rows).collect():
        got.setdefault(r.suttaid, []).append((r.kind, r.commentary_id))
    assert {k: sorted(v) for k, v in got.items()} == {
        "AN 1.1": [("sutta", "cAN 1.1")],
        "AN 1.2": [("chain", "cc"), ("commentary", "cc")],
        "AN 1.3": [("combined", "cAN 1.3")],
    }
    chain = records.to_documents(rows).filter("kind = 'chain'").first().text
    assert chain.splitlines()[-3:] == ["Items:", "  1. one", "  2. two"]
    ids = spark.createDataFrame([("2.1.2",), ("an 2.1",), (" ",), ("AN ",)], "x string")
    assert [r.v for r in ids.select(records.prefixed_id("x").alias("v")).collect()] == ["AN 2.1.2", "AN 2.1", "", "AN AN"]


def test_items_keep_repeats_of_the_first_book_only(spark):
    one = [(i, i, "AN 1", None, "s", None, None, None, None) for i in range(2)]
    two = [(i, i, None, s, "s", None, None, None, None) for i, s in enumerate(["1", "2", "2"])]
    a = records.to_items(spark.createDataFrame(one, RECORDS_DDL), "an1")
    b = records.to_items(spark.createDataFrame(two, RECORDS_DDL), "an2")
    merged = [(r.book, r.suttaid, r.pos) for r in records.merge_items(a, b).orderBy("book", "pos").collect()]
    assert merged == [("an1", "AN 1", 0), ("an1", "AN 1", 1), ("an2", "AN 2", 1)]
    assert records.find_item(a, "suttaid", " ").count() == 0
    assert records.for_book(a.unionByName(b), "AN2 ").count() == 3 and records.for_book(a, "x").count() == 2


def chunk_frame(spark, rows):
    ddl = "pos bigint, source string, suttaid string, commentary_id string, conversation_id string, kind string, book string, text string, embedding array<float>"
    return spark.createDataFrame(rows, ddl)


def test_quota_sizes(spark):
    def rows(n1, n2):
        out = [(i, "s", f"AN {i}", "", "", "sutta", "an1" if i < n1 else "an2", f"t{i}", [1.0, float(i)]) for i in range(n1 + n2)]
        pool = retrieval.candidates(chunk_frame(spark, out), "zzz yyy", [1.0, 0.0], 8, retrieval.BUNDLE)
        return retrieval.best(pool, 40)

    def split(df, k):
        got = retrieval.quota_pick(df, k).groupBy("book").count().collect()
        return {r.book: r["count"] for r in got}

    assert split(rows(10, 10), 5) == {"an1": 3, "an2": 2}
    assert split(rows(12, 1), 8) == {"an1": 7, "an2": 1}
    assert split(rows(10, 0), 4) == {"an1": 4}


def test_bundle_search_pairs_and_kinds(spark):
    rows = [
        (0, "s", "AN 1", "cAN 1", "", "sutta", "an1", "alpha beta", [1.0, 0.0]),
        (1, "s", "AN 1", "cAN 1", "", "commentary", "an1", "gamma", [0.0, 1.0]),
        (2, "s", "AN 2", "cAN 2", "", "chain", "an2", "alpha beta two", [0.9, 0.1]),
        (3, "s", "AN 2", "cAN 2", "", "sutta", "an2", "delta alpha", None),
        (4, "s", "AN 3", "cAN 3", "", "sutta", "an2", "nothing", [0.1, 0.9]),
        (5, "s", "AN 3", "cAN 3", "", "commentary", "an2", "no vector, no term", None),
    ]
    got = retrieval.search_bundle(chunk_frame(spark, rows), "alpha beta", [1.0, 0.0], 2).orderBy("rank").collect()
    assert [r.pos for r in got] == [0, 2, 1, 3]
    assert 5 not in [r.pos for r in got]
    with pytest.raises(ValueError):
        retrieval.search_bundle(chunk_frame(spark, rows), "alpha", [1.0, 0.0], 21)
    reranked = retrieval.search_transcripts(chunk_frame(spark, rows), "alpha", [1.0, 0.0], 2, models.pair_scorer())
    assert reranked.count() == 2
    passages = retrieval.order_passages(retrieval.bounded(retrieval.search_bundle(chunk_frame(spark, rows), "alpha beta", [1.0, 0.0], 2), 14))
    assert [r.pos for r in passages.orderBy("rank").collect()] == [0, 1, 3, 2]


def test_context_stays_in_the_conversation(spark):
    rows = [(i, "f", "", "", "c1" if i % 2 else "c2", "chat", "", f"text {i} {'needle' if i == 3 else ''}", [float(i), 1.0]) for i in range(20)]
    chunks = chunk_frame(spark, rows)
    found = retrieval.search_transcripts(chunks, "needle", [3.0, 1.0], 1)
    around = retrieval.expand_context(found, chunks).orderBy("rank").collect()
    assert [r.pos for r in around] == [3, 1, 5, 7, 9, 11, 13, 15]


def test_segments(spark):
    files = spark.createDataFrame(
        [
            ("Book 4 a.txt", "lead text 4.4.36 doṇa body. then 4.5.2 more " + "x" * 100),
            ("Book 1A b.txt", "intro " + "y" * 100 + " one point two point three hello 2.3.4"),
            ("other.txt", "no book 3.4.5 here"),
            ("Book 3 c.txt", "   "),
        ],
        "file_name string, text string",
    )
    rows = segments.segment_files(files).orderBy("json_file", "segment_index").collect()
    got = {}
    for r in rows:
        got.setdefault(r.json_file, []).append((r.transcript_id, r.canon_id, r.book))
    assert got["Book 1A b.json"] == [("1.2.3", "an1.3", 1), ("1.2.3", "an1.3", 1)]
    assert got["other.json"] == [("3.4.5", "an3.5", 3)]
    # The marker rule rewrites the id inside its new header, which leaves an empty body.
    assert ("4.36", "an4.36", 4) in got["Book 4 a.json"] and ("4.5.2", "an4.2", 4) in got["Book 4 a.json"]
    assert "Book 3 c.json" not in got


def test_enrichment_rules(spark):
    rows = spark.createDataFrame(
        [(0, "4.8.79", "an4.79", "4.8.79 text", ""), (1, "4.8.79", "an4.79", "the next sutta is", "old"), (2, "", "", "x", "old"), (3, "4.8.79", "an4.79", "4.8.79", "mine")],
        "i int, transcript_id string, canon_id string, transcript_content string, canon_content string",
    )
    canon = spark.createDataFrame([("an4.79", "canon")], "canon_id string, canon_text string")
    full = {r.i: r.canon_content for r in segments.enrich(rows, canon, spread="i").collect()}
    assert full == {0: "canon", 1: "", 2: "", 3: "canon"}
    only = {r.i: r.canon_content for r in segments.enrich(rows, canon, spread="i", only_missing=True).collect()}
    assert only == {0: "canon", 1: "", 2: "", 3: "mine"}


def test_annotation(spark):
    rows = spark.createDataFrame(
        [(0, "3", "deeds are the field and consciousness is the seed and craving is the moisture", "deeds are the field, consciousness is the seed, craving is the moisture"),
         (1, "7", "unrelated words entirely", "zzz qqq"), (2, "3", "a", "")],
        "i int, book string, transcript_content string, canon_content string",
    )
    got = {r.i: r for r in Al.annotate(rows).collect()}
    assert got[0].mapping_quality == "ok" and got[0].chain_extraction == "field_seed_moisture" and len(got[0].chains[0]) == 4
    assert got[1].mapping_quality in ("bad", "suspect") and got[1].chain_extraction == "skipped_book"
    assert (got[2].use, got[2].mapping_quality_reason, got[2].mapping_agreement_score) == ("no", "empty_canon_text", None)
    lines = [r.line for r in Al.census_lines(Al.annotate(rows).withColumn("canon_id", F.lit("an3.1"))).collect()]
    assert lines[0] == "total_segments: 3" and lines[-2:] == ["  empty_canon: 1", "  field_seed_moisture: 1"]


def test_units(spark):
    a, b, c = "alpha " * 40, "beta " * 40, "gamma " * 20
    long = f"{a}the next sutta is {b}that's the end of the Suta {c}"
    rows = spark.createDataFrame([("7.1.2", 7, long), ("7.1.3", 7, "Short  Row"), ("7.1.4", 7, "x" * 400)], "teacher_id string, book int, text string")
    got = {r.unit_id: r.text for r in mapping.split_units(rows).collect()}
    assert set(got) == {"7.1.2#a", "7.1.2#b", "7.1.2#c", "7.1.3#a", "7.1.4#a"}
    assert got["7.1.2#a"].endswith("the next sutta is") and got["7.1.2#b"].endswith("that's the end of the sutta")
    assert got["7.1.3#a"] == "Short Row" and got["7.1.4#a"] == "x" * 400
    two = {r.unit_id for r in mapping.split_units(rows, max_units=2).collect()}
    assert "7.1.2#b" in two and "7.1.2#c" not in two
    assert {r.unit_id for r in mapping.split_units(rows, max_units=1).collect()} == {"7.1.2#a", "7.1.3#a", "7.1.4#a"}
    text = spark.createDataFrame([("intro 1.2.3 one 1.2.3.4 x 10.20.30 end",)], "text string")
    assert [(r.teacher_id, r.text) for r in mapping.teacher_rows(text).collect()] == [("1.2.3", "1.2.3 one"), ("1.2.3", "1.2.3.4 x"), ("10.20.30", "10.20.30 end")]


@pytest.mark.parametrize("limit", [64, 3])
def test_candidates_equal_brute_force(spark, monkeypatch, limit):

    rng = random.Random(5)
    words = "noble path right view effort mind faith energy power wisdom seven five".split()
    def say(n):
        return " ".join(rng.choice(words) for _ in range(n))

    canon = [(i, f"an{i % 2 + 1}.{i}", i % 2 + 1, "t", say(rng.randint(5, 60))) for i in range(150)]
    units = [(f"u{i}", i % 2 + 1, say(rng.randint(5, 60))) for i in range(12)] + [("copy", 1, None)]
    units[-1] = ("copy", 1, units[0][2])
    cdf = spark.createDataFrame(canon, "pos bigint, canon_id string, book int, title string, opening string")
    udf = spark.createDataFrame(units, "unit_id string, book int, text string")
    monkeypatch.setattr(mapping, "TEXTS", limit)
    monkeypatch.setattr(mapping, "TILE", limit)
    got = {}
    for r in mapping.candidate_scores(udf, cdf, 4).orderBy("unit_id", "rank").collect():
        got.setdefault(r.unit_id, []).append((round(r.score, 9), r.pos))
    for uid, book, text in units:
        scored = [(difflib.SequenceMatcher(None, text[:320], o[:320]).ratio(), p) for p, _, b, _, o in canon if b == book]
        best = sorted(scored, key=lambda x: (-x[0], x[1]))[:4]
        assert got[uid] == [(round(s, 9), p) for s, p in best]


def test_fallback_choice(spark):
    ddl = "best_canon_ids array<string>, primary_canon_id string, confidence double, is_mixed boolean, needs_review boolean, evidence_phrases array<string>, reason string, match_type string, top_score double, second_score double, top_canon_id string"
    row = ([], None, 0.0, False, True, [], "", "unknown")
    df = spark.createDataFrame([row + (0.245, 0.185, "an7.1"), row + (0.24, 0.22, "an7.1"), row + (0.1, None, "an7.1")], ddl)
    got = mapping.assign_status(mapping.apply_fallback(df)).orderBy("top_score").collect()
    assert [r.fallback_used for r in got] == [False, False, True]
    assert (got[2].match_type, got[2].confidence, got[2].status) == ("probable", 0.845, "needs_review")


def test_subtitles_and_merge(spark):
    raw = "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:02.000\nhello <c>world</c>\nhello world\nhello world again\n1\n00:00:01,000 --> x"
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(subtitles.clean_subtitles("t").alias("v")).first().v == "hello world hello world again 1 00:00:01,000 --> x"
    files = spark.createDataFrame([("Book 2 b.txt", "B \n"), ("Book 2 a.txt", "A"), ("Book 12.txt", "no")], "file_name string, text string")
    rows = subtitles.merge_by_book(files).orderBy("book", "ord", "file_name").collect()
    assert len({r.book for r in rows}) == 11
    assert "".join(r.text for r in rows if r.book == 2) == (
        "===== MERGED BOOK 2 =====\n\n\n===== SOURCE: Book 2 a.txt =====\nA\n\n\n===== SOURCE: Book 2 b.txt =====\nB\n"
    )


def scripted():
    """Factory of a model that replies by what the prompt asks (local, so that it travels by value)."""

    class Scripted:
        def generate(self, system, user):
            if "too short" in system:
                return "a long enough reply that says something useful " + 'SUGGESTIONS_JSON: ["more?"]'
            if "weak" in user:
                return "short"
            if "field" in system:
                return 'Sure: {"best_canon_ids": ["an1.0"], "confidence": 0.95, "match_type": "exact", "evidence_phrases": ["noble path effort"]}'
            return "NOT_RELEVANT" if "skip me" in user and "From excerpt" not in user else "fact"

    return Scripted


def test_answer_stages(spark):
    ask = models.generate_column(scripted())
    rows = spark.createDataFrame([(1, "s", "c", "use me"), (2, "s", "", "skip me")], "rank int, source string, conversation_id string, text string")
    got = A.map_reduce_answer(rows, "why the path", ask).first()
    assert (got.answer, got.notes) == ("fact", 1)
    nothing = A.map_reduce_answer(rows.filter("rank = 2"), "why", ask).first()
    assert nothing.answer == A.NO_ANSWER_FOUND
    assert A.answer(rows, "hello", ask).first().answer == A.GREETING_REPLY
    assert A.answer(rows.limit(0), "why the path", ask).first().answer == A.NO_PASSAGES
    prompts = spark.createDataFrame([("rules", "weak"), ("rules", "fine")], "system string, user string")
    replies = {r.user: (r.reply, r.suggestions) for r in A.chat_reply(prompts, ask).collect()}
    assert replies["weak"][0].startswith("a long enough") and replies["weak"][1] == ["more?"]
    units = spark.createDataFrame([("u1", 1, "noble path 1.2.3"), ("u2", 9, "x")], "unit_id string, book int, text string")
    canon = spark.createDataFrame([(i, f"an1.{i}", 1, "t", f"noble path {i}", ["k"]) for i in range(6)], "pos bigint, canon_id string, book int, title string, opening string, keywords array<string>")
    scores = mapping.candidate_scores(units, canon, 5)
    chosen = {r.unit_id: r for r in mapping.assign_status(A.choose_canon(units, canon, scores, ask)).collect()}
    assert (chosen["u1"].status, chosen["u1"].primary_canon_id) == ("accept", "an1.0")
    assert chosen["u2"].status == "needs_review" and chosen["u2"].reason.startswith("No sufficient")
    assert A.starter_prompt(" q ", ["1", " ", "2"], ["a", ""]) == '{"looked_for": "q", "saw": ["1", "2"], "asked_before": ["a"]}'
    decomposed = spark.createDataFrame([("- first query\n2. second one\nx", "q"), ("", "q")], "r string, q string")
    assert [r.v for r in decomposed.select(A.sub_queries("r", "q").alias("v")).collect()] == [[" first query", " second one"], ["q"]]


def test_a_long_conversation_is_one_record(spark):
    """More turns than a block of the sort, each written twice over a border."""
    n = 10_500
    turns = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.floor(F.col("id") / 2).cast("string").alias("text")
    )
    rows = C.nest_turns(turns).collect()
    assert len(rows) == 1 and [m.content for m in rows[0].messages] == [str(i // 2) for i in range(n)]
    kept = C.nest_turns(turns).select(F.size(C.drop_repeats(F.col("messages"))).alias("n")).first().n
    assert kept == n // 2
    equal = turns.withColumn("text", F.lit("same"))
    assert C.nest_turns(equal).select(F.size(C.drop_repeats(F.col("messages"))).alias("n")).first().n == 1
    text = C.nest_turns(turns).select(C.flatten_messages(F.lit("s"), F.lit("1"), "messages").alias("t")).first().t
    assert text.count("[source=") == 1 and text.count("USER: ") == n
    assert C.conversion_counts(C.nest_turns(turns.filter("turn > 9000"))).first().written == 1


def test_choices_without_texts_are_invalid(spark):
    from corpusloom.operators import answers as A

    def say(reply):
        return lambda system, user: F.when(user.isNotNull(), F.lit(reply))

    units = spark.createDataFrame([("u1", 1, "noble path")], "unit_id string, book int, text string")
    canon = spark.createDataFrame([(i, f"an1.{i}", 1, "t", f"noble path {i}", ["k"]) for i in range(6)], "pos bigint, canon_id string, book int, title string, opening string, keywords array<string>")
    scores = mapping.candidate_scores(units, canon, 5)
    row = A.choose_canon(units, canon, scores, say('{"match_type": "exact", "best_canon_ids": [], "reason": "so"}')).first()
    assert (row.match_type, row.needs_review, row.reason) == ("unknown", True, "so Empty best_canon_ids invalidated.")
    row = A.choose_canon(units, canon, scores, say("no json at all")).first()
    assert (row.match_type, row.needs_review) == ("unknown", True) and row.reason
    row = A.choose_canon(units, canon, scores, say('{"match_type": "exact", "best_canon_ids": ["an1.0"]}')).first()
    assert (row.match_type, row.needs_review) == ("exact", False)


def test_turns_of_one_time_keep_their_line_order(spark):
    uid = "00000000-0000-4000-8000-000000000001"
    turns = spark.createDataFrame(
        [(uid, 5, "second", "a", 1, 2), (uid, 5, "first", "a", 1, 1), (uid, 9, "late", "a", 3_600_001, 3)],
        "conversation_id string, ts bigint, q string, a string, latency_ms bigint, line_no int",
    )
    fit = C.accepted_turns(turns)
    assert fit.count() == 2
    index = spark.createDataFrame([], "id string, title string, updated_ts bigint")
    assert C.upsert_index(index, fit).first().title == "first"
    assert [r.q for r in C.conversation_messages(turns, uid).collect()] == ["first", "second", "late"]


def test_missing_report_lines(spark):
    from corpusloom.operators import segments

    rows = [("b.json", 2, "1.1", "an1.1", ""), ("a.json", 10, " ", "an1.2", None), ("a.json", 9, "1.1", "an1.1", " "), ("a.json", 1, "1.3", "an1.3", "text"), ("a.json", 2, "x", "", "")]
    frame = spark.createDataFrame(rows, "json_file string, segment_index int, transcript_id string, canon_id string, canon_content string")
    assert [r.line for r in segments.missing_lines(frame).collect()] == [
        "Total segments with canon_id but empty canon_content: 3", "",
        "Unique (canon_id, transcript_id) pairs — tab-separated columns:", "Count: 2", "canon_id\ttranscript_id", "an1.1\t1.1", "an1.2\t(empty)", "",
        "Distinct canon_id only (count 2):", "an1.1", "an1.2", "",
        "--- Full segment list (tab-separated) ---", "json_file\tsegment_index\ttranscript_id\tcanon_id", "a.json\t9\t1.1\tan1.1", "a.json\t10\t\tan1.2", "b.json\t2\t1.1\tan1.1",
    ]


def test_chunks_from_pieces_equal_those_of_the_whole_text(spark, monkeypatch):
    monkeypatch.setattr(chunking, "STRIDE", 700)
    monkeypatch.setattr(chunking, "TOGETHER", 3)
    rng = random.Random(12)
    rows = []
    for g in range(40):
        for i in range(rng.choice([1, 2, 5, 60])):
            piece = rng.choice([None, "", " " * rng.randint(0, 4000), "word. " * rng.randint(0, 900), "x" * rng.randint(0, 5000), "é word " * rng.randint(0, 300)])
            rows.append((g, i, piece))
    rows += [(None, 0, "a key that is null. " * 200), (99, 0, " "), (99, 1, None)]
    df = spark.createDataFrame(rows, "g bigint, i int, text string")
    found = {}
    for r in chunking.chunk_pieces(df, "g", ["i"], between="\n\n").collect():
        found.setdefault(r.g, {})[r.chunk_index] = r.text
    whole = {}
    for g, i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        whole[g] = t or "" if g not in whole else whole[g] + "\n\n" + (t or "")
    from corpusloom.functions.native import chunk_spans

    want = {g: [t[a:b] for a, b in chunk_spans(t)] for g, t in whole.items() if t.strip()}
    assert {g: [c[k] for k in sorted(c)] for g, c in found.items()} == want
    assert all(sorted(c) == list(range(len(c))) for c in found.values())


@pytest.mark.parametrize("tile,texts", [(3, 4), (5, 2), (64, 128)])
def test_candidates_over_many_tiles_equal_brute_force(spark, monkeypatch, tile, texts):
    monkeypatch.setattr(mapping, "TILE", tile)
    monkeypatch.setattr(mapping, "TEXTS", texts)
    monkeypatch.setattr(mapping, "SPAN", 25)
    rng = random.Random(tile)
    word = lambda: "".join(rng.choice("abcdeg") for _ in range(rng.randint(1, 5)))
    openings = [" ".join(word() for _ in range(rng.choice([1, 3, 12, 40, 70])))[:320].strip() for _ in range(60)]
    openings += openings[:4] + ["a" * 250]
    own = [" ".join(word() for _ in range(rng.choice([1, 5, 30, 60])))[:300].strip() for _ in range(20)] + openings[2:9] + ["a"]
    canon = spark.createDataFrame([(1 + i % 2, i, o) for i, o in enumerate(openings)], "book int, pos bigint, opening string")
    units = spark.createDataFrame([(f"u{i}", 1 + i % 2, t) for i, t in enumerate(own)], "unit_id string, book int, text string")
    found: dict = {}
    for r in mapping.candidate_scores(units, canon, 4).orderBy("unit_id", "rank").collect():
        found.setdefault(r.unit_id, []).append((round(r.score, 12), r.pos))
    for i, t in enumerate(own):
        scores = [(difflib.SequenceMatcher(None, t[:320], o[:320]).ratio(), p) for p, o in enumerate(openings) if p % 2 == i % 2]
        want = sorted(scores, key=lambda s: (-s[0], s[1]))[:4]
        assert found[f"u{i}"] == [(round(s, 12), p) for s, p in want], (t, i)
    work = mapping.candidate_work(units, canon, 4).agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored")).first()
    assert work.pairs >= work.scored > 0


def test_similarity_keys_of_long_texts(spark, monkeypatch):
    """The key is that of the whole text, and the rest of a text behind it is not normalised."""
    K = mapping.K.SIMILARITY_CHARS
    own = ["", None, "Short one", "word, " * 500, " \n\t" * 900 + "Late  Words " * 90, "A" * 318 + " ..." * 300 + "end", "İ" * 400, "ΑΣ" + "ʰ" * 2000 + "α", "x" * 319 + "Σ" + "'" * 1000 + "y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "i int, text string")
    whole = F.substring(mapping.normalize_for_similarity("text"), 1, K)
    rows = df.select("i", mapping.similarity_key("text").alias("key"), whole.alias("whole")).collect()
    assert all(r.key == r.whole for r in rows) and len(rows) == len(own)
    units = df.select(F.col("i").cast("string").alias("unit_id"), F.lit(1).alias("book"), "text")
    canon = spark.createDataFrame([(0, 1, "word word")], "pos bigint, book int, opening string")
    stored_columns = []
    keep = mapping.stored
    monkeypatch.setattr(mapping, "stored", lambda d, what: stored_columns.append(d.columns) or keep(d, what))
    assert mapping.candidate_scores(units, canon, 1).count() == len(own)
    assert ["unit_id", "book", "_key"] in stored_columns


def test_bounds_hold_and_tables_are_those_of_the_texts():
    rng = random.Random(11)
    own, openings = [""], ["", "x"]
    for alphabet in ("ab", "abcdefg ", "etaoinshrdlu     cmfwypvbgkqjxz0123456789", "aé😀 ß一"):
        say = lambda: "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 3, 30, 150, 199, 200, 260, 320])))  # noqa: B023, E731
        openings += [say() for _ in range(6)]
        own += [say() for _ in range(4)] + [o[: len(o) // 2] + say() for o in openings[-3:]] + openings[-2:]
    prepared = [Prepared(o) for o in openings]
    bounds, numbered = Bounds(own).to(Bounds(openings, prepared)), Texts(own)
    for j, other in enumerate(prepared):
        tables = other.tables(numbered) if other.plain else None
        for i, text in enumerate(own):
            want = difflib.SequenceMatcher(None, text, other.text).ratio()
            assert ratio(text, other, table=numbered.table(i, tables) if other.plain else None) == want
            assert bounds[i, j] >= want - 1e-12
    assert Bounds([""]).to(Bounds(openings, prepared)).shape == (1, len(openings))
    assert ratio("", prepared[1], table=Texts([""]).table(0, prepared[1].tables(Texts([""])))) == 0.0


def test_long_openings_out_of_reach_are_not_scored(spark):
    """In a long opening only rare characters start a block, so one that has little around them in common is not scored."""
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("etaoinshrdlu     etaoinsr     cmfwypvbgkqjxz") for _ in range(n))
    openings = [say(300) for _ in range(40)] + [say(150) for _ in range(4)]
    canon = spark.createDataFrame([(1, i, o) for i, o in enumerate(openings)], "book int, pos bigint, opening string")
    units = spark.createDataFrame([(f"u{i}", 1, say(300)) for i in range(30)], "unit_id string, book int, text string")
    work = mapping.candidate_work(units, canon, 2).first()
    assert work.pairs == 30 * 44 and work.scored < 0.4 * work.pairs

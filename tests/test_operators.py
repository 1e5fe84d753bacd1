"""Hand-made cases."""

import itertools
import json
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from scrubline.functions import geometry, text
from scrubline.operators import dedup, email, entities, fuzzy, paragraphs, raster, reflow, review, spans, vectors
from scrubline.plans import queries
from scrubline.sources import sinks, tables


def test_merge_small_paragraphs(spark):
    lengths = [10, 60, 20, 20, 70]
    rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(lengths)], "doc_id long, line_idx int, line string")
    got = [(r.chunk_idx, len(r.text), r.n_lines) for r in paragraphs.merge_small(rows).orderBy("chunk_idx").collect()]
    assert got == [(0, 10, 1), (1, 60 + 1 + 20 + 1 + 20, 3), (2, 70, 1)]


def test_lines_of_long_and_short_documents(spark):
    long = "\n".join(f"line {i}" for i in range(300))
    docs = spark.createDataFrame([(1, "a\n\nbc"), (2, long), (3, None), (4, "")], "doc_id long, text string")
    got = {(r.doc_id, r.line_idx): (r.line, r.offset) for r in paragraphs.lines(docs).collect()}
    assert got[1, 2] == ("bc", 3) and got[3, 0] == ("", 0)
    assert all(long[o : o + len(x)] == x for (d, _), (x, o) in got.items() if d == 2) and len(got) == 3 + 300 + 2


def test_exact_duplicates(spark):
    docs = spark.createDataFrame([(0, "A b"), (1, "B"), (2, "A b"), (3, "  a  B\n"), (4, ""), (5, None), (6, "")], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc_id) for r in dedup.exact_duplicates(docs, ["doc_id"], "text").collect()} == {(2, 0), (3, 0)}


def test_normalisers(spark):
    row = spark.createDataFrame([("Hello From: me\n> Quoted\n>> Twice  x", "Anna’s (big) “house”.", "Words’s.)", "ﬁne​ x y")], "a string, b string, c string, d string")
    got = row.select(text.normalize_text(F.col("a")), text.needle_key(F.col("b")), text.haystack_key(F.col("b")), text.occurrence_key(F.col("c")), text.normalize_pdf_text(F.col("d"))).first()
    assert tuple(got) == ("hello quoted twice x", "annabig“house”", "annabighouse", "word", "fine x y")


@pytest.mark.parametrize(("raw", "name"), [("Sent", "date"), ("Reply To", "reply_to"), ("Reply – To", "reply_to"), ("Attachment", "attachments"), ("X-Other", None), ("MESSAGE-ID", "message_id")])
def test_header_names(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "n string").select(text.header_name(F.col("n"))).first()[0] == name


THREAD = """Hello before any start, dropped.
From: a@example.org
To: b@example.org   Subject: plans
Sent: Monday

I would like to meet you all on Tuesday at the usual place.
On Mon, B wrote:
> I would like to ask when we might meet, and where it should be.
-----Original Message-----
From: c@example.org
Subject: one
Subject: two

Short."""


def test_split_and_parse_thread():
    blocks = email.split_thread(THREAD)
    assert len(blocks) == 3 and blocks[0].startswith("From: a@") and blocks[1].startswith("On Mon") and "Original" in blocks[2]
    headers, body = email.parse_block(blocks[0])
    assert headers == {"from": "a@example.org", "to": "b@example.org", "subject": "plans", "date": "Monday"} and body.startswith("I would like to meet")
    headers, body = email.parse_block(blocks[2])
    assert headers == {"from": "c@example.org", "subject": "one two"} and body == "Short."
    assert email.parse_block(blocks[1])[1].startswith("I would like to ask")
    assert email.split_thread("no start here") == ["no start here"] and email.split_thread("") == []


def test_email_duplicates(spark):
    first = "This is the first message of the thread, with enough text."
    edited = first.replace("first", "opening")
    rows = [(1, 0, first), (1, 1, "I agree.\n" + first.upper()), (1, 2, "So be it.\n" + edited), (1, 3, "I agree."), (1, 4, "")]
    blocks = spark.createDataFrame(rows, "doc_id long, email_idx int, body string")
    assert {(r.source_email_index, r.target_email_index) for r in email.contained(blocks).collect()} == {(0, 1)}
    fuzzy = {(r.source_email_index, r.target_email_index): r.coverage for r in email.fuzzy(blocks).collect()}
    assert (0, 2) in fuzzy and fuzzy[0, 2] >= 0.7 and (0, 3) not in fuzzy


def test_contains_email(spark):
    body = "A body that is long enough to count as one for this rule, surely."
    docs = [(1, f"From: a\nTo: b\n\n{body}"), (2, f"From: a\n\n{body}"), (3, f"From: a\nMessage-ID: 7\n\n{body}"), (4, "From: a\nTo: b\n\nshort"), (5, None)]
    got = {r.doc_id: r.is_email for r in email.contains_email(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_entities_and_redaction(spark):
    docs = spark.createDataFrame([(1, "é mail bob@example.org, host 10.0.0.300 and 10.0.0.1; card 4111 1111 1111 1111 x"), (2, None), (3, "nothing")], "doc_id long, text string")
    found = entities.recognise(docs).collect()
    assert {(r.category, r.text) for r in found} == {("Email", "bob@example.org"), ("IPAddress", "10.0.0.1"), ("CreditCardNumber", "4111 1111 1111 1111")}
    source = docs.first().text
    assert all(source[r.offset : r.offset + r.length] == r.text for r in found)
    masked = {r.doc_id: (r.text, r.n_masked) for r in entities.redact(docs, spark.createDataFrame([(1, 2, 4), (1, 4, 6)], "doc_id long, offset int, length int")).collect()}
    assert masked[1] == (source[:2] + "█" * 8 + source[10:], 8) and masked[2] == ("", 0) and masked[3] == ("nothing", 0)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


def test_similarity_is_the_subsequence_ratio():
    random.seed(5)
    for _ in range(300):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(1, 12))) for _ in range(2))
        assert spans.similarity(a, b) == round(200 * lcs(a, b) / (len(a) + len(b)))


def test_locate_uses_words_once(spark):
    docs = spark.createDataFrame([(1, 'John Smith met "John Smith" and Jon Smith\nJohn')], "doc_id long, text string")
    words = spans.words(paragraphs.lines(docs))
    findings = spark.createDataFrame([(1, 0, 1, "John Smith"), (1, 0, 2, "John Smith"), (1, 0, 3, "John"), (1, 0, 4, "absent")], "doc_id long, page int, finding_id long, text string")
    got = {r.finding_id: (r.first_word, r.last_word, r.score) for r in spans.locate(words, findings).collect()}
    assert got == {1: (0, 1, 100), 2: (3, 4, 100), 3: (8, 8, 100)}


def test_merge_rectangles_at_the_gap(spark):
    rows = [(1, 0.0, 2.5, 10.0, 12.5), (1, 17.5, 2.5, 30.0, 12.5), (1, 37.6, 2.4, 40.0, 12.4), (1, 0.0, 3.5, 5.0, 13.5)]
    got = spans.merge_rectangles(spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double"), ["k"]).collect()
    assert sorted((r.x0, r.x1) for r in got) == [(0.0, 5.0), (0.0, 30.0), (37.6, 40.0)]


def test_reflow(spark):
    lines = spark.createDataFrame([(1, 0, i, i * 12.0, i * 12.0 + 10) for i in range(6)], "doc_id long, page int, line_idx int, y0 double, y1 double")
    one = spark.createDataFrame([(1, 0, 23.5, 24.0)], "doc_id long, page int, top double, bottom double")
    assert {(r.line_idx, r.y0) for r in reflow.reflow(lines, one).collect()} == {(0, 0.0), (3, 14.0), (4, 26.0), (5, 38.0)}
    none = spark.createDataFrame([(1, 0, 900.0, 910.0)], one.schema)
    assert reflow.reflow(lines, none).count() == 6
    two = spark.createDataFrame([(1, 0, 12.0, 20.0), (1, 0, 48.0, 50.0)], one.schema)
    assert {r.line_idx for r in reflow.reflow_all(lines, two).collect()} == {0, 2, 3}
    assert {r.line_idx for r in reflow.reflow_all(lines, two, rebase=True).collect()} == {0, 2, 3, 5}


def test_vectors(spark):
    near = [1.0, 0.2]
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, near), (4, [0.0, 0.0]), (5, [0.0, 1.0]), (6, [-1.0, 0.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pairs = {(r.i, r.j): r.similarity for r in vectors.near_pairs(frame, 0.9, block=2).collect()}
    assert set(pairs) == {(1, 2), (1, 3), (2, 3)} and pairs[1, 2] == 1.0
    groups = {r.member: r.group_id for r in vectors.duplicate_groups(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "i long, j long")).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert {(r.i, r.j) for r in vectors.neighbours(frame, 2, 0.9, block=2).collect()} == {(1, 2)}


def test_geometry(spark):
    row = spark.createDataFrame([([1.0, 2.0, 5.0, 2.0, 5.0, 8.0, 1.0, 8.0], 0x10FF02)], "p array<double>, c int")
    got = row.select(*geometry.polygon_bounds(F.col("p")), geometry.rgb(F.col("c")), geometry.is_valid(F.lit(0.0), F.lit(0.0), F.lit(float("inf")), F.lit(1.0)), geometry.relative(F.lit(3.0), F.lit(0.0)), *geometry.polygon_bounds(F.array().cast("array<double>"))[:1]).first()
    assert tuple(got)[:4] == (1.0, 2.0, 5.0, 8.0) and list(got[4]) == [16, 255, 2] and got[5] is False and got[6] == 0.0 and got[7] == 0.0


def test_review_and_undo(spark):
    sugg = spark.createDataFrame([(1, "a", "x", "E"), (1, "b", "x", "E"), (1, "c", "y", "F")], "doc_id long, id string, text string, category string")
    ok = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "id string, approved boolean")
    assert {r.text: (r.n_instances, r.all_approved) for r in review.grouped(sugg, ok).collect()} == {"x": (2, True), "y": (1, False)}
    assert {r.id for r in review.undo(sugg, spark.createDataFrame([(1, "b")], "doc_id long, id string")).collect()} == {"a", "c"}


def test_raster(spark):
    rows = spark.createDataFrame([(1, i, [255] * 4 if i in (2, 3, 4, 8, 9) else [0] * 4) for i in range(12)], "image_id int, row int, pixels array<int>")
    profile = raster.row_profile(rows)
    cut = raster.white_cuts(profile, spark.createDataFrame([(1, 8)], "image_id int, target int")).first()
    assert cut.cut == 3 and raster.content_extent(profile).first().last_row == 11


def test_layout_and_log(spark, tmp_path):
    result = {"content": "ab", "paragraphs": [{"content": "a", "role": None, "spans": [{"offset": 0, "length": 1}], "bounding_regions": [{"page_number": 1, "polygon": [0, 0, 1, 0, 1, 1, 0, 1]}]}, {"content": "b", "spans": []}], "pages": [{"page_number": 1, "width": 8.5, "height": 11.0, "lines": [], "words": []}]}
    (tmp_path / "x.json").write_text(json.dumps(result))
    blocks = {r.text: (r.page, r.width) for r in tables.layout_blocks(tables.layout(spark, str(tmp_path / "x.json"))).collect()}
    assert blocks == {"a": (0, 8.5), "b": (None, 1.0)}
    log = spark.createDataFrame([('q"x', "Email", 0.8, 1, 3)], tables.LOG_SCHEMA)
    sinks.append_log(log, str(tmp_path / "log"))
    sinks.append_log(log, str(tmp_path / "log"))
    assert [r.text for r in tables.recogniser_log(spark, str(tmp_path / "log")).collect()] == ['q"x', 'q"x']


def test_stream_keeps_first_texts(spark, tmp_path):
    from scrubline.streaming.dedup import first_texts

    source = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:00:00", "A b"), ("2024-01-01 00:01:00", " a  b"), ("2024-01-01 00:02:00", "c")], "ts string, text string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(source)
    stream = first_texts(spark.readStream.schema("ts timestamp, text string").parquet(source))
    q = stream.writeStream.format("memory").queryName("first_texts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("first_texts").count() == 2


def _fuzzy_by_brute_force(rows):
    texts = {}
    for i, lang, t in sorted(rows):
        n = re.sub(r"[ \t\n\x0b\f\r]+", " ", (t or "").lower()).strip(" ")
        if len(n) >= 30:
            texts.setdefault((lang, n), []).append(i)
    found = set()
    for ((la, a), x), ((lb, b), y) in itertools.permutations(texts.items(), 2):
        p, q = set(a.split(" ")), set(b.split(" "))
        if x[0] < y[0] and la == lb and 0.9 <= len(a) / len(b) <= 1 / 0.9 and len(p & q) >= 0.6 * max(len(p), len(q)) and email.coverage(a, b) >= 0.7:
            found |= {(x[0], i) for i in y}
    return found


def test_fuzzy_documents_against_brute_force(spark, tmp_path):
    """Near copies that begin differently, or are near a later document only, are found."""
    rng = random.Random(2)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 30, 60]))]
        other = words[: len(words) // 2] + [f"o{rng.randrange(10**6)}" for _ in words[len(words) // 2 :]]
        for v in (other, words, ["Opening", *words[1:]], [*words[:-1], "end"], words):
            rows.append((len(rows), "en" if g % 3 else None, " ".join(v)))
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = _fuzzy_by_brute_force(rows)
    assert {(1, 2), (1, 3), (2, 3), (2, 4)} & expected
    assert {(r.source_id, r.target_id) for r in queries.QUERIES["fuzzy_documents"](spark, str(tmp_path)).collect()} == expected


def _written(spark, run) -> int:
    """Bytes that a run leaves in the checkpoint folder."""
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    run()
    return size() - before


def _long_rows():
    rng = random.Random(3)
    return [(i, "en", " ".join(f"w{rng.randrange(10**6)}" for _ in range(800))) for i in range(60)]


def test_fuzzy_documents_write_no_texts(spark):
    rows = _long_rows()
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert _written(spark, lambda: fuzzy.near_documents(frame, 0.6).collect()) < sum(len(r[2]) for r in rows) / 2


def test_word_pairs_in_parts(spark):
    """All pairs are found, within a cell and across the lengths of two, when words are dealt into parts."""
    rng = random.Random(4)
    rows = []
    for g in range(30):
        words = [f"w{rng.randrange(10**4)}" for _ in range(rng.randrange(6, 80))]
        rows += [(3 * g + k, words[: len(words) - k * len(words) // 20] + [f"n{k}"]) for k in range(3)]
    texts = spark.createDataFrame([(i, i, "en", len(" ".join(w)), " ".join(w)) for i, w in rows], "doc_id long, of long, lang string, chars int, text string")
    near = {(a, b) for (a, p), (b, q) in itertools.combinations(rows, 2) if 0.9 <= len(" ".join(p)) / len(" ".join(q)) <= 1 / 0.9 and len(set(p) & set(q)) >= 0.6 * max(len(set(p)), len(set(q)))}
    for parts in ({}, {("en", k): 3 for k in range(60)}):
        found = [(min(r.a, r.b), max(r.a, r.b)) for r in fuzzy.word_pairs(texts, len(rows), parts, 0.6).collect()]
        assert len(near) > 30 and near <= set(found) and len(found) == len(set(found)) < 2 * len(near)


def test_covered_is_the_sequence_matchers_coverage():
    rng = random.Random(6)
    for k in range(120):
        words = ["".join(rng.choice("etaoinéüzxq!.") for _ in range(rng.randrange(1, 9))) for _ in range(rng.choice([5, 40, 300]))]
        other = [w if rng.random() < 0.7 + k % 4 / 10 else w[::-1] for w in words] + words[: k % 7]
        a, b = " ".join(words), " ".join(other)
        expected = email.coverage(a, b)
        assert fuzzy.covered(a, b, 0.0) == expected and fuzzy.covered(a, b, 0.7) == (expected if expected >= 0.7 else None)


def test_contained_texts_write_no_texts(spark):
    rows = _long_rows()
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert _written(spark, lambda: dedup.contained_texts(frame).collect()) < sum(len(r[2]) for r in rows) / 2


def test_contained_texts_against_brute_force(spark):
    """Proper parts are found, cut inside words too."""
    rng = random.Random(5)
    whole = [" ".join(f"w{rng.randrange(10**6)}x" for _ in range(40)) for _ in range(6)]
    texts = whole + [t[7:200] for t in whole] + [whole[0][10:45], f"x {whole[1]} y", whole[2], whole[3][:31], "q" * 35, "a" + "q" * 40, whole[4].upper(), "short", None]
    rows = list(enumerate(texts))
    n = {i: re.sub(r"[ \t\n\x0b\f\r]+", " ", (t or "").lower()).strip(" ") for i, t in rows}
    expected = {(a, b) for a in n for b in n if a != b and len(n[a]) >= 30 and n[a] in n[b] and a == min(c for c in n if n[c] == n[a])}
    assert {(6, 0), (12, 0), (1, 13), (16, 17)} <= expected
    got = [(r.source_id, r.target_id) for r in dedup.contained_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_entity_rules_read_the_documents(spark, tmp_path):
    rows = [(50, "Ann was born on 01/02/1990 and left on 03/04/2020."), (51, "write to Dan@example.org or eve@example.org")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: [r for r in queries.QUERIES[name](spark, str(tmp_path)).collect() if r.doc_id > 0]
    assert {(r.text, r.is_kept) for r in run("document_entity_validate") if r.category == "DateTime"} == {("01/02/1990", True), ("03/04/2020", False)}
    assert {(r.doc_id, r.is_needed) for r in run("document_linking_needed")} == {(50, False), (51, False)}
    assert {r.text for r in run("document_entity_exceptions") if r.category == "Email"} == {"eve@example.org"}


def test_rules_end_at_word_boundaries(spark):
    inside = ["XAB123456CX", "1.2.3.4.5", "x01/02/20201", "0001.2.3.4", "aged 1234", "UTR 12345678901", "a_key = \"x\"", "+44123456789012345678", "12 Hill Streets", "Xaged 12"]
    whole = {"AB123456C": "UKNationalInsuranceNumber", "1.2.3.4": "IPAddress", "01/02/2020": "DateTime", "aged 12": "Age", "UTR 1234567890": "UKUniqueTaxpayerReferenceNumber", 'key = "x"': "Secret", "12 Hill Street": "Address"}
    docs = spark.createDataFrame([*enumerate(inside), *((100 + k, f"({t}), ") for k, t in enumerate(whole))], "doc_id long, text string")
    found = {(r.doc_id, r.text, r.category) for r in entities.recognise(docs).collect()}
    assert found == {(100 + k, t, c) for k, (t, c) in enumerate(whole.items())}


def test_a_text_without_a_categorys_character_holds_no_match():
    samples = ["a@b.org", "1.2.3.4", "+44 20 7946 0958", "AB12/34", "UTR: 1234567890", "Passport No: AB1234567", "01/02/2020", 'secret = "y"']
    for category, part in queries.rules.HOLDS.items():
        hits = [m[0] for s in samples for m in re.finditer(queries.rules.PATTERNS[category], s)]
        assert hits and all(part in h for h in hits)


def test_vectors_of_other_lengths_and_with_odd_components(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [1.0, float("nan"), 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, []), (7, None), (8, [2.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.i, r.j) for r in vectors.near_pairs(frame, -1.0).collect()] == [(1, 8)]
    assert [(r.i, r.j) for r in vectors.neighbours(frame, 3, -1.0).collect()] == [(1, 8)]


def test_markers_without_dashes_and_whole_ones():
    thread = "From: a@example.org\n\nFirst body.\nOriginal Message\nFrom: b@example.org\n\nSecond body. -----Forwarded Message-----\nFrom: c@example.org\n\nThird body.\n-----Original Message-----\nFrom: d@example.org\n\nLast body."
    found = email.split_thread(thread)
    assert [b.split("\n")[0] for b in found] == ["From: a@example.org", "Original Message", "-----Forwarded Message-----", "-----Original Message-----"]
    assert [email.parse_block(b)[1] for b in found] == ["First body.", "Second body.", "Third body.", "Last body."]


def test_findings_from_chunks(spark):
    rows = [
        (1, 0, "Dr Hill, born on 01/02/1990, mails hill@example.org on 03/04/2020."), (1, 1, "Dr Reed writes to reed@example.org"), (1, 2, "Dr Hill and Dr Reed share ann@example.org"),
        (1, 3, "only eve@example.org and bob@example.org at Hill Academy or Acme Ltd"), (1, 4, None), (1, 5, ""),
    ]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_idx int, text string")
    excepted = spark.createDataFrame([("dr reed",), ("eve@example.org",)], "value string")
    run = lambda **k: {(r.chunk_idx, r.text, r.category) for r in entities.findings(chunks, excepted, key=["doc_id", "chunk_idx"], **k).collect()}
    first = {(0, "Dr Hill", "Person"), (0, "01/02/1990", "DateOfBirth"), (0, "hill@example.org", "Email")}
    third, last = {(2, "Dr Hill", "Person"), (2, "Dr Reed", "Person"), (2, "ann@example.org", "Email")}, {(3, "bob@example.org", "Email"), (3, "Hill Academy", "School")}
    assert run() == first | third | last  # a sole person owns the chunk; of two, nobody does
    links = spark.createDataFrame([(1, 2, "ann@example.org", "Dr Reed")], "doc_id long, chunk_idx int, text string, owner string")
    assert run(links=links) == first | {(1, "Dr Reed", "Person"), (1, "reed@example.org", "Email")} | third - {(2, "ann@example.org", "Email")} | last
    model = spark.createDataFrame([(1, 3, "Zoe", "Person", 0, 3, rows[3][2])], "doc_id long, chunk_idx int, text string, category string, offset int, length int, content string")
    assert (3, "Zoe", "Person") in run(others=model)


def test_areas_of_pages_that_are_not_there(spark):
    asked = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (1, "c", -1), (1, "d", None), (2, "e", 0)], "doc_id long, id string, page int")
    got = review.applied(asked, spark.createDataFrame([(1, 2)], "doc_id long, n_pages int")).collect()
    assert {r.id: r.is_applied for r in got} == {"a": True, "b": False, "c": False, "d": False, "e": False}

"""Registered queries: each with the same result in SQL where SQL can express it.

Names of columns and types agree between a query and its SQL. White space, boundaries and rounding are
spelled out so that Spark and other engines give equal values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry, rules, text
from ..operators import dedup, email, entities, fuzzy, paragraphs, raster, reflow, review, spans, vectors
from ..sources.sinks import annotations
from ..sources.tables import table, threads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Cosine from which rows of the test vectors count as near.
NEAR = 0.40
#: Share of the larger set of distinct words that fuzzy documents have in common.
WORDS_SHARED = 0.6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL building blocks ------------------------------------------------------------------------------
_SP = r"[ \t\n\x0b\f\r]"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'))"


def _norm(x: str) -> str:
    bare = f"regexp_replace(coalesce({x}, ''), '(?im)({text.HEADER_LABELS}).*?$', '', 'g')"
    return _collapse(f"lower(regexp_replace({bare}, '(?m)^>+{_SP}?', '', 'g'))")


def _email_norm(x: str) -> str:
    return _collapse(f"lower(coalesce({x}, ''))")


_LINES = "lines AS (SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) - 1 AS INT) AS line_idx, unnest(l) AS line, unnest(o) AS \"offset\" FROM (SELECT doc_id, l, list_transform(range(1, len(l) + 1), lambda i: CAST(coalesce(list_sum(list_transform(l[1:i-1], lambda x: length(x) + 1)), 0) AS INT)) AS o FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"
_PARAS = f"{_LINES}, paras AS (SELECT * FROM lines WHERE trim(line) <> '')"
_CHUNKS = f"{_PARAS}, marked AS (SELECT *, CASE WHEN length(line) >= 50 OR row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) = 1 THEN 1 ELSE 0 END AS opens FROM paras), numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS BIGINT) AS chunk_idx FROM marked), chunks AS (SELECT doc_id, chunk_idx, string_agg(line, chr(10) ORDER BY line_idx) AS text, CAST(count(*) AS INT) AS n_lines FROM numbered GROUP BY 1, 2)"
_WORDS = f"{_LINES}, pieces AS (SELECT doc_id, line_idx, \"offset\" AS lo, unnest(range(len(w))) AS word_idx, unnest(w) AS word FROM (SELECT *, string_split(line, ' ') AS w FROM lines)), placed AS (SELECT *, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS col FROM pieces), words AS (SELECT doc_id, CAST(line_idx // 60 AS INT) AS page, line_idx, CAST(word_idx AS INT) AS word_idx, word, lo + col AS \"offset\", col * 6.0::DOUBLE AS x0, (line_idx % 60) * 12.0::DOUBLE AS y0, (col + length(word)) * 6.0::DOUBLE AS x1, (line_idx % 60) * 12.0::DOUBLE + 10 AS y1 FROM placed WHERE word <> '')"


def _matches_sql(names: list[str] | None = None, source: str = "documents", key: str = "doc_id", patterns: dict[str, str] = rules.PATTERNS) -> str:
    q = lambda p: p.replace("'", "''")
    one = lambda c, p: f"SELECT {key}, '{c}' AS category, unnest(list_transform(range(2, len(p), 2), lambda i: {{'text': p[i], 'offset': CAST(length(array_to_string(p[1:i-1], '')) AS INT), 'length': CAST(length(p[i]) AS INT)}})) AS m FROM (SELECT {key}, string_split(regexp_replace(t, '{q(p)}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM (SELECT {key}, replace(coalesce(text, ''), chr(1), ' ') AS t FROM {source}))"
    parts = " UNION ALL ".join(one(c, p) for c, p in patterns.items() if names is None or c in names)
    digits = "regexp_replace(text, '[^0-9]', '', 'g')"
    luhn = f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({digits}), i, 1)::INT ELSE substr(reverse({digits}), i, 1)::INT * 2 - CASE WHEN substr(reverse({digits}), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"
    nhs = f"((11 - list_sum(list_transform(range(1, 10), lambda i: (11 - i) * substr({digits}, i, 1)::INT)) % 11) % 11 = substr({digits}, 10, 1)::INT)"
    octets = "(regexp_full_match(text, '[0-9]{1,3}(\\.[0-9]{1,3}){3}') AND len(list_filter(string_split(text, '.'), lambda o: o::INT > 255)) = 0)"
    valid = f"CASE category WHEN 'IPAddress' THEN {octets} WHEN 'CreditCardNumber' THEN {luhn} WHEN 'UKNationalHealthNumber' THEN {nhs} WHEN 'PhoneNumber' THEN length({digits}) BETWEEN 9 AND 15 ELSE true END"
    return f"raw AS ({parts}), flat AS (SELECT {key}, category, m.text AS text, m.\"offset\" AS \"offset\", m.length AS length FROM raw), ents AS (SELECT * FROM flat WHERE {valid})"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _paras(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs.lines(_docs(spark, d)).where(F.trim("line") != "")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return spans.words(paragraphs.lines(_docs(spark, d)))


# normalisation and keys ---------------------------------------------------------------------------
@query(f"SELECT doc_id, {_norm('text')} AS normalized FROM documents")
def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {_email_norm('text')} AS normalized FROM documents")
def normalize_email(spark, d):
    return _docs(spark, d).select("doc_id", text.normalize_email(F.col("text")).alias("normalized"))


@query()
def normalize_pdf_text(spark, d):
    return _docs(spark, d).select("doc_id", text.normalize_pdf_text(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, regexp_replace(coalesce(text, ''), '(?m)^{_SP}*(?:>{_SP}*)+', '', 'g') AS bare FROM documents")
def without_quotes(spark, d):
    return _docs(spark, d).select("doc_id", text.without_quotes(F.coalesce("text", F.lit(""))).alias("bare"))


def _replaced(x: str, marks) -> str:
    for m in marks:
        x = f"replace({x}, '{m.replace(chr(39), chr(39) * 2)}', '')"
    return x


@query(f"SELECT doc_id, {_replaced('lower(text)', text.NEEDLE_MARKS)} AS needle, {_replaced('lower(text)', text.NEEDLE_MARKS + text.QUOTE_MARKS)} AS haystack FROM documents")
def match_key(spark, d):
    return _docs(spark, d).select("doc_id", text.needle_key(F.col("text")).alias("needle"), text.haystack_key(F.col("text")).alias("haystack"))


# exact duplicates ---------------------------------------------------------------------------------
@query(f"WITH h AS (SELECT doc_id, sha256(n) AS hash FROM (SELECT doc_id, {_norm('text')} AS n FROM documents) WHERE n <> '') SELECT doc_id, hash, first_doc_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY hash) AS first_doc_id FROM h) WHERE doc_id <> first_doc_id")
def exact_duplicates(spark, d):
    return dedup.exact_duplicates(_docs(spark, d), ["doc_id"], "text")


_PDUP = f"WITH {_LINES}, h AS (SELECT doc_id, line_idx, sha256(n) AS hash FROM (SELECT doc_id, line_idx, {_norm('line')} AS n FROM lines) WHERE n <> ''), f AS (SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(line_idx) OVER w AS first_line_idx FROM h WINDOW w AS (PARTITION BY hash ORDER BY doc_id, line_idx)) SELECT doc_id, line_idx, hash, first_doc_id, first_line_idx FROM f WHERE (doc_id, line_idx) <> (first_doc_id, first_line_idx)"


@query(_PDUP)
def paragraph_duplicates(spark, d):
    return dedup.exact_duplicates(paragraphs.lines(_docs(spark, d)), ["doc_id", "line_idx"], "line")


@query(f"SELECT (SELECT count(*) FROM (WITH {_PARAS} SELECT * FROM paras)) AS blocks_count, (SELECT count(*) FROM ({_PDUP})) AS exact_count, (SELECT count(*) FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {NEAR}) AS near_count")
def dup_summary(spark, d):
    near = vectors.near_pairs(table(spark, d, "embeddings"), NEAR)
    parts = {"blocks_count": _paras(spark, d), "exact_count": paragraph_duplicates(spark, d), "near_count": near}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit(name)) for name, df in parts.items()]
    rows = counts[0].unionAll(counts[1]).unionAll(counts[2])
    return rows.agg(*(F.max(F.when(F.col("of") == name, F.col("n"))).alias(name) for name in parts))


@query("WITH n AS (SELECT doc_id, " + _email_norm("text") + " AS n FROM documents) SELECT a.doc_id AS source_id, b.doc_id AS target_id FROM n a JOIN n b ON a.n = b.n AND a.doc_id < b.doc_id AND length(a.n) >= 30 AND a.doc_id = (SELECT min(doc_id) FROM n c WHERE c.n = a.n)")
def contained_documents(spark, d):
    """Documents whose whole collapsed text is another's, with the first such document."""
    n = _docs(spark, d).select("doc_id", text.normalize_email(F.col("text")).alias("n")).where(F.length("n") >= email.LEAST_SOURCE)
    keyed = n.select("doc_id", F.sha2("n", 256).alias("h"))
    first = keyed.groupBy("h").agg(F.min("doc_id").alias("source_id"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return keyed.join(first, "h").where("doc_id <> source_id").select("source_id", F.col("doc_id").alias("target_id"))


@query("WITH n AS (SELECT doc_id, " + _email_norm("text") + " AS n FROM documents) SELECT a.doc_id AS source_id, b.doc_id AS target_id FROM n a JOIN n b ON contains(b.n, a.n) AND a.doc_id <> b.doc_id AND length(a.n) >= 30 AND a.doc_id = (SELECT min(doc_id) FROM n c WHERE c.n = a.n)")
def contained_texts(spark, d):
    """Documents whose collapsed text holds another's, whole or as a part, with the first document of that text."""
    return dedup.contained_texts(_docs(spark, d))


@query(f"WITH d AS (SELECT doc_id, {_email_norm('text')} AS n FROM documents), b AS (SELECT item_id, {_email_norm('text')} AS n FROM benchmark WHERE length({_email_norm('text')}) >= 30) SELECT DISTINCT doc_id, item_id FROM d JOIN b ON contains(d.n, b.n)")
def benchmark_containment(spark, d):
    return dedup.contained_items(_docs(spark, d), table(spark, d, "benchmark"))


# paragraphs ---------------------------------------------------------------------------------------
@query(f"WITH {_CHUNKS} SELECT * FROM chunks")
def merge_small_paragraphs(spark, d):
    return paragraphs.merge_small(_paras(spark, d))


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_idx, coalesce(lag(text) OVER w, '') AS previous, coalesce(lead(text) OVER w, '') AS next FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_idx)")
def paragraph_context(spark, d):
    return paragraphs.context(paragraphs.merge_small(_paras(spark, d))).select("doc_id", "chunk_idx", "previous", "next")


@query(f"WITH {_PARAS}, r AS (SELECT *, CASE WHEN line_idx = min(line_idx) OVER w THEN 'pageHeader' WHEN line_idx = max(line_idx) OVER w THEN 'pageFooter' END AS role FROM paras WINDOW w AS (PARTITION BY doc_id)) SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_idx) FILTER (role IS NULL), string_agg(line, chr(10) ORDER BY line_idx)) AS body FROM r GROUP BY doc_id")
def body_text(spark, d):
    p = _paras(spark, d)
    ends = p.groupBy("doc_id").agg(F.min("line_idx").alias("a"), F.max("line_idx").alias("b"))
    role = F.when(F.col("line_idx") == F.col("a"), F.lit("pageHeader")).when(F.col("line_idx") == F.col("b"), F.lit("pageFooter"))
    return paragraphs.body_text(p.join(ends, "doc_id").withColumn("role", role))


# entities -----------------------------------------------------------------------------------------
@query(f"WITH {_matches_sql()} SELECT * FROM ents")
def pii_entities(spark, d):
    return entities.recognise(_docs(spark, d))


def _one_category(name: str, category: str) -> None:
    def run(spark, d):
        return entities.recognise(_docs(spark, d), [category])

    run.__name__ = name
    query(f"WITH {_matches_sql([category])} SELECT * FROM ents")(run)


for _name, _category in (("pii_email", "Email"), ("pii_ip", "IPAddress"), ("pii_card", "CreditCardNumber"), ("pii_phone", "PhoneNumber"), ("pii_secret", "Secret")):
    _one_category(_name, _category)

#: A small set of recognised entities with their chunks, for the rules that the documents don't exercise.
_FIXTURE = [
    (1, "born on 01/02/1990 in", "01/02/1990", "DateTime"), (2, "signed on 01/02/1990", "01/02/1990", "DateTime"), (3, "Date of Birth: 03/04/1985", "03/04/1985", "DateTime"),
    (4, "attends Hill Academy daily", "Hill Academy", "Organization"), (5, "works at Acme Ltd", "Acme Ltd", "Organization"), (6, "she is 42 years", "42", "Quantity"),
    (7, "mail ann@example.org", "ann@example.org", "Email"), (7, "mail ann@example.org", "Ann", "Person"), (8, "Bob and Carol", "Bob", "Person"), (8, "Bob and Carol", "Carol", "Person"),
    (9, "Dan, dan@example.org", "Dan", "Person"), (9, "Dan, dan@example.org", "dan@example.org", "Email"), (10, "dob 1/1/2000, then paid much later on 02/02/2020", "02/02/2020", "DateTime"),
]
_LINKS = [(7, "ann@example.org", "Ann"), (9, "dan@example.org", "Dan"), (9, "Dan", "Dan")]
_EXCEPTIONS = ["ann", "carol", "dan@example.org"]


def _quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) AS v({names})"


_FIX_SQL = f"fix AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, content, text, category, CAST(greatest(instr(lower(content), lower(text)) - 1, 0) AS INT) AS \"offset\", CAST(length(text) AS INT) AS length FROM {_values(_FIXTURE, 'doc_id, content, text, category')})"


def _fixture(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_FIXTURE, "doc_id long, content string, text string, category string")
    return rows.withColumn("offset", F.greatest(F.instr(F.lower("content"), F.lower("text")) - 1, F.lit(0))).withColumn("length", F.length("text"))


_BORN = " OR ".join(f"contains(b, '{w}')" for w in entities.BIRTH_WORDS)
_SCHOOL = " OR ".join(f"contains(lower(text), '{w}')" for w in entities.SCHOOL_WORDS)


@query(f"WITH {_FIX_SQL}, c AS (SELECT *, lower(substr(content, greatest(0, \"offset\" - 20) + 1, \"offset\" - greatest(0, \"offset\" - 20))) AS b FROM fix) SELECT doc_id, text, category, CASE category WHEN 'DateTime' THEN ({_BORN}) WHEN 'Organization' THEN ({_SCHOOL}) ELSE true END AS is_kept, CASE category WHEN 'DateTime' THEN 'DateOfBirth' WHEN 'Organization' THEN 'School' ELSE category END AS final_category FROM c")
def entity_validate(spark, d):
    return entities.validate(_fixture(spark)).select("doc_id", "text", "category", "is_kept", "final_category")


@query(f"WITH {_FIX_SQL} SELECT doc_id, (bool_or(category = 'Person') AND bool_or(category <> 'Person')) AS is_needed FROM fix GROUP BY doc_id")
def entity_linking_needed(spark, d):
    return entities.linking_needed(_fixture(spark))


_EXC_SQL = f"{_FIX_SQL}, need AS (SELECT doc_id, (bool_or(category = 'Person') AND bool_or(category <> 'Person')) AS n FROM fix GROUP BY doc_id), links AS (SELECT * FROM {_values(_LINKS, 'doc_id, text, owner')}), tested AS (SELECT fix.*, CASE WHEN n THEN lower(owner) ELSE lower(fix.text) END AS t FROM fix JOIN need USING (doc_id) LEFT JOIN links ON links.doc_id = fix.doc_id AND links.text = fix.text), found AS (SELECT doc_id, text, category, 'Identified as sensitive PII (' || category || ').' AS reasoning FROM tested WHERE t IS NULL OR t NOT IN ({', '.join(map(_quoted, _EXCEPTIONS))}))"


@query(f"WITH {_EXC_SQL} SELECT * FROM found")
def entity_exceptions(spark, d):
    links = spark.createDataFrame(_LINKS, "doc_id long, text string, owner string")
    exceptions = spark.createDataFrame([(x,) for x in _EXCEPTIONS], "value string")
    return entities.without_exceptions(_fixture(spark), exceptions, links).select("doc_id", "text", "category", "reasoning")


# the same rules over the rule entities of whole documents and the fixture's, whose ids are negative
_ALL_SQL = f"{_matches_sql()}, {_FIX_SQL}, entities AS (SELECT e.doc_id, replace(coalesce(d.text, ''), chr(1), ' ') AS content, e.text, category, e.\"offset\", e.length FROM ents e JOIN documents d USING (doc_id) UNION ALL SELECT -doc_id, content, text, category, \"offset\", length FROM fix)"


def _all_entities(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    content = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\x01", " ").alias("content"))
    fixed = _fixture(spark).withColumn("doc_id", -F.col("doc_id"))
    return entities.recognise(docs).join(content, "doc_id").select(fixed.columns).unionByName(fixed)


@query(f"WITH {_ALL_SQL}, c AS (SELECT *, lower(substr(content, greatest(0, \"offset\" - 20) + 1, \"offset\" - greatest(0, \"offset\" - 20))) AS b FROM entities) SELECT doc_id, \"offset\", text, category, CASE category WHEN 'DateTime' THEN ({_BORN}) WHEN 'Organization' THEN ({_SCHOOL}) ELSE true END AS is_kept, CASE category WHEN 'DateTime' THEN 'DateOfBirth' WHEN 'Organization' THEN 'School' ELSE category END AS final_category FROM c")
def document_entity_validate(spark, d):
    return entities.validate(_all_entities(spark, d)).select("doc_id", "offset", "text", "category", "is_kept", "final_category")


@query(f"WITH {_ALL_SQL} SELECT doc_id, (bool_or(category = 'Person') AND bool_or(category <> 'Person')) AS is_needed FROM entities GROUP BY doc_id")
def document_linking_needed(spark, d):
    return entities.linking_needed(_all_entities(spark, d))


@query(f"WITH {_ALL_SQL}, need AS (SELECT doc_id, (bool_or(category = 'Person') AND bool_or(category <> 'Person')) AS n FROM entities GROUP BY doc_id), links AS (SELECT -doc_id AS doc_id, text, owner FROM {_values(_LINKS, 'doc_id, text, owner')}), tested AS (SELECT e.*, CASE WHEN n THEN lower(owner) ELSE lower(e.text) END AS t FROM entities e JOIN need USING (doc_id) LEFT JOIN links ON links.doc_id = e.doc_id AND links.text = e.text) SELECT doc_id, \"offset\", text, category, 'Identified as sensitive PII (' || category || ').' AS reasoning FROM tested WHERE t IS NULL OR t NOT IN ({', '.join(map(_quoted, _EXCEPTIONS))})")
def document_entity_exceptions(spark, d):
    links = spark.createDataFrame([(-i, t, o) for i, t, o in _LINKS], "doc_id long, text string, owner string")
    exceptions = spark.createDataFrame([(x,) for x in _EXCEPTIONS], "value string")
    found = _all_entities(spark, d).drop("content")
    return entities.without_exceptions(found, exceptions, links).select("doc_id", "offset", "text", "category", "reasoning")


_FINDINGS = f"WITH {_CHUNKS}, {_matches_sql(None, 'chunks', 'doc_id, chunk_idx', rules.PATTERNS | rules.NAME_PATTERNS)}, near AS (SELECT e.*, lower(substr(replace(c.text, chr(1), ' '), greatest(0, \"offset\" - 20) + 1, \"offset\" - greatest(0, \"offset\" - 20))) AS b FROM ents e JOIN chunks c USING (doc_id, chunk_idx)), kept AS (SELECT *, CASE category WHEN 'DateTime' THEN 'DateOfBirth' WHEN 'Organization' THEN 'School' ELSE category END AS final FROM near WHERE CASE category WHEN 'DateTime' THEN ({_BORN}) WHEN 'Organization' THEN ({_SCHOOL}) ELSE true END), owners AS (SELECT doc_id, chunk_idx, (bool_or(category = 'Person') AND bool_or(category <> 'Person')) AS n, CASE WHEN min(text) FILTER (category = 'Person') = max(text) FILTER (category = 'Person') THEN lower(min(text) FILTER (category = 'Person')) END AS owner FROM kept GROUP BY 1, 2) SELECT doc_id, chunk_idx, text, final AS category, \"offset\", length, 'Identified as sensitive PII (' || final || ').' AS reasoning FROM kept JOIN owners USING (doc_id, chunk_idx) WHERE coalesce(CASE WHEN n THEN owner ELSE lower(text) END, '') NOT IN ({', '.join(map(_quoted, _EXCEPTIONS))})"


@query(_FINDINGS)
def document_findings(spark, d):
    """Documents through chunks, entities, context, owners and exceptions to findings."""
    chunks = paragraphs.merge_small(_paras(spark, d))
    return entities.findings(chunks, spark.createDataFrame([(x,) for x in _EXCEPTIONS], "value string"), key=["doc_id", "chunk_idx"])


#: Words that a sensitive-content rule looks for in lines, and the user's exceptions to it.
_RULE, _RULE_EXCEPTIONS = r"(?i)(license|licensed|copyright|confidential)", ["released under the mit license."]


@query(f"WITH {_LINES} SELECT doc_id, line_idx, line AS text, 'SensitiveContent' AS category FROM lines WHERE regexp_matches(line, '{_RULE}') AND lower(line) NOT IN ({', '.join(map(_quoted, _RULE_EXCEPTIONS))})")
def sensitive_findings(spark, d):
    found = paragraphs.lines(_docs(spark, d)).where(F.col("line").rlike(_RULE)).withColumn("key", F.lower("line"))
    exceptions = spark.createDataFrame([(x,) for x in _RULE_EXCEPTIONS], "key string")
    return found.join(exceptions, "key", "left_anti").select("doc_id", "line_idx", F.col("line").alias("text"), F.lit("SensitiveContent").alias("category"))


@query(f"WITH {_matches_sql()} SELECT category, count(*) AS n, count(DISTINCT text) AS n_texts, min(length) AS min_length, max(length) AS max_length, round_even(avg(length), 3) AS avg_length FROM ents GROUP BY category")
def entity_stats(spark, d):
    return entities.statistics(entities.recognise(_docs(spark, d)))


@query(f"WITH {_matches_sql()}, cover AS (SELECT doc_id, list(\"offset\") AS a, list(\"offset\" + length) AS b FROM ents GROUP BY doc_id), c AS (SELECT d.doc_id, coalesce(d.text, '') AS text, a, b FROM documents d LEFT JOIN cover USING (doc_id)), m AS (SELECT doc_id, text, CASE WHEN a IS NULL THEN [] ELSE list_distinct(flatten(list_transform(range(1, len(a) + 1), lambda i: range(a[i], b[i])))) END AS hidden FROM c), k AS (SELECT doc_id, text, hidden, list_sort(hidden) AS s FROM m) SELECT doc_id, CASE WHEN len(s) = 0 THEN text ELSE list_reduce(list_prepend(text, list_transform(s, lambda p: p::VARCHAR)), lambda acc, p: substr(acc, 1, p::INT) || '█' || substr(acc, p::INT + 2)) END AS text, CAST(len(s) AS INT) AS n_masked FROM k")
def redact_text(spark, d):
    docs = _docs(spark, d)
    return entities.redact(docs, entities.recognise(docs))


@query(f"WITH {_matches_sql()} SELECT text, count(*) AS n_unmapped FROM ents e WHERE category NOT IN ('Email', 'IPAddress') GROUP BY text")
def unmapped_report(spark, d):
    """Findings whose text was not located: here those of the categories that the location step was not given."""
    found = entities.recognise(_docs(spark, d))
    located = found.where(F.col("category").isin("Email", "IPAddress"))
    return entities.unmapped(found, located)


@query(f"WITH {_matches_sql(['Email', 'IPAddress', 'Secret'])} SELECT e.doc_id, e.\"offset\", substr(replace(d.text, chr(1), ' '), greatest(0, e.\"offset\" - 30) + 1, e.\"offset\" + e.length + 60 - greatest(0, e.\"offset\" - 30)) AS snippet FROM ents e JOIN documents d USING (doc_id)")
def context_snippets(spark, d):
    docs = _docs(spark, d)
    found = entities.recognise(docs, ["Email", "IPAddress", "Secret"]).select("doc_id", "offset", "length")
    rows = found.join(docs.select("doc_id", F.translate("text", "\x01", " ").alias("t")), "doc_id")
    return rows.select("doc_id", "offset", text.around(F.col("t"), F.col("offset"), 30, F.col("length") + 60).alias("snippet"))


# e-mail threads -----------------------------------------------------------------------------------
_THREADS = "turns AS (SELECT conv_id, turn, role, replace(text, chr(13), ' ') AS text, CASE WHEN row_number() OVER w % 2 = 0 THEN lag(replace(text, chr(13), ' ')) OVER w END AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), threads AS (SELECT conv_id AS doc_id, string_agg('From: ' || role || '@example.org' || chr(10) || 'To: ' || CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END || '@example.org' || chr(10) || 'Subject: conv ' || conv_id || chr(10) || chr(10) || text || coalesce(chr(10) || before, ''), chr(10) ORDER BY turn) AS text FROM turns GROUP BY conv_id)"
_BLOCKS = f"{_THREADS}, parts AS (SELECT doc_id, unnest(range(len(p))) AS n, unnest(p) AS content FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^From: ', chr(1) || 'From: ', 'g'), chr(1)) AS p FROM threads)), trimmed AS (SELECT doc_id, CAST(n - 1 AS INT) AS email_idx, trim(regexp_replace(content, '\\n+$', '')) AS content FROM parts WHERE n > 0), blocks AS (SELECT *, CASE WHEN instr(content, chr(10) || chr(10)) > 0 THEN substr(content, instr(content, chr(10) || chr(10)) + 2) ELSE '' END AS body, CASE WHEN instr(content, chr(10) || chr(10)) > 0 THEN substr(content, 1, instr(content, chr(10) || chr(10)) - 1) ELSE content END AS header FROM trimmed)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return email.clean_blocks(threads(table(spark, d, "conversations")))


@query(f"WITH {_BLOCKS} SELECT doc_id, bool_or(length(trim(regexp_replace(body, '[^A-Za-z0-9]', '', 'g'))) > 0 AND (SELECT sum(CASE WHEN regexp_matches(x, '[A-Za-z0-9]') THEN length(trim(x)) ELSE 0 END) FROM (SELECT unnest(string_split(body, chr(10))[1:119]) AS x)) >= 40) AS is_email FROM blocks GROUP BY doc_id")
def email_docs(spark, d):
    return email.contains_email(threads(table(spark, d, "conversations")))


@query(f"WITH {_BLOCKS} SELECT doc_id, email_idx, content, body FROM blocks")
def email_blocks(spark, d):
    return _blocks(spark, d).drop("header")


@query(f"WITH {_BLOCKS}, h AS (SELECT doc_id, email_idx, unnest(string_split(header, chr(10))) AS line FROM blocks) SELECT doc_id, email_idx, lower(regexp_extract(line, '^([A-Za-z]+): (.+)$', 1)) AS name, trim(regexp_extract(line, '^([A-Za-z]+): (.+)$', 2)) AS value FROM h")
def email_headers(spark, d):
    return email.headers(_blocks(spark, d))


_EPAIRS = f"{_BLOCKS}, n AS (SELECT doc_id, email_idx, {_email_norm('body')} AS n FROM blocks), pairs AS (SELECT s.doc_id, s.email_idx AS source_email_index, t.email_idx AS target_email_index, s.n AS sn, t.n AS tn FROM n s JOIN n t ON s.doc_id = t.doc_id AND s.email_idx < t.email_idx WHERE length(s.n) >= 30 AND t.n <> '')"


@query(f"WITH {_EPAIRS} SELECT doc_id, source_email_index, target_email_index, 'exact' AS type FROM pairs WHERE contains(tn, sn)")
def email_duplicates(spark, d):
    return email.contained(_blocks(spark, d))


@query()
def email_duplicates_fuzzy(spark, d):
    return email.fuzzy(_blocks(spark, d))


@query()
def email_blocks_any_style(spark, d):
    return email.blocks(threads(table(spark, d, "conversations")))


# vectors ------------------------------------------------------------------------------------------
_PAIRS = f"pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), near AS (SELECT i, j, round_even(c, 4) AS similarity FROM pairs WHERE c >= {NEAR})"


@query(f"WITH {_PAIRS} SELECT * FROM near")
def near_pairs(spark, d):
    return vectors.near_pairs(table(spark, d, "embeddings"), NEAR)


@query(f"WITH s AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON true), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS k FROM s) SELECT i, j, round_even(c, 4) AS similarity FROM r WHERE k <= 5 AND j > i AND c >= {NEAR}")
def knn_neighbours(spark, d):
    return vectors.neighbours(table(spark, d, "embeddings"), 5, NEAR)


@query(f"WITH RECURSIVE {_PAIRS}, e AS (SELECT i AS a, j AS b FROM near UNION SELECT j, i FROM near), reach AS (SELECT a AS node, a AS seen FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.seen = e.a) SELECT min(seen) AS group_id, node AS member FROM reach GROUP BY node")
def duplicate_groups(spark, d):
    return vectors.duplicate_groups(near_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT i, j, round_even(1 - d * d / 2, 4) AS cosine FROM (SELECT i, j, sqrt(2 - 2 * similarity) AS d FROM near)")
def angular_cosine(spark, d):
    distance = F.sqrt(2 - 2 * F.col("similarity"))
    return near_pairs(spark, d).select("i", "j", F.bround(vectors.angular_to_cosine(distance), 4).alias("cosine"))


# geometry -----------------------------------------------------------------------------------------
@query(f"WITH {_WORDS}, b AS (SELECT doc_id, line_idx, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY 1, 2) SELECT *, greatest(0, x1 - x0) AS width, greatest(0, y1 - y0) AS height, x0 / 612 AS rx0, y0 / 792 AS ry0, x1 / 612 AS rx1, y1 / 792 AS ry1 FROM b")
def bbox(spark, d):
    w = _words(spark, d).groupBy("doc_id", "line_idx").agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("e"))
    polygon = F.array("a", "b", "c", "b", "c", "e", "a", "e")
    rows = w.select("doc_id", "line_idx", *(c.alias(n) for c, n in zip(geometry.polygon_bounds(polygon), ("x0", "y0", "x1", "y1"), strict=True)))
    side = {"x0": 612.0, "x1": 612.0, "y0": 792.0, "y1": 792.0}
    return rows.select("*", geometry.extent(F.col("x0"), F.col("x1")).alias("width"), geometry.extent(F.col("y0"), F.col("y1")).alias("height"), *(geometry.relative(F.col(c), F.lit(s)).alias(f"r{c}") for c, s in side.items()))


@query(f"WITH {_WORDS} SELECT doc_id, line_idx, word_idx, x0 * (72.0::DOUBLE / 150.0::DOUBLE) * (1275.0::DOUBLE / 800.0::DOUBLE) AS px0, y0 * 72 AS py0 FROM words")
def scale_rects(spark, d):
    return _words(spark, d).select("doc_id", "line_idx", "word_idx", geometry.canvas_to_points(F.col("x0"), F.lit(1275.0)).alias("px0"), geometry.inches_to_points(F.col("y0")).alias("py0"))


@query(f"WITH {_WORDS} SELECT doc_id, count(*) FILTER (x0 < x1 AND y0 - (word_idx % 3) * 5 < y1 - 10) AS n_valid, count(*) AS n FROM words GROUP BY doc_id")
def valid_rects(spark, d):
    w = _words(spark, d)
    ok = geometry.is_valid(F.col("x0"), F.col("y0") - F.col("word_idx") % 3 * 5, F.col("x1"), F.col("y1") - 10)
    return w.groupBy("doc_id").agg(F.count_if(ok).alias("n_valid"), F.count(F.lit(1)).alias("n"))


_FONTS = [("Helvetica", "auto"), ("Times-Bold", "base14"), ("Arial", "auto"), ("Courier", "helvetica"), ("Symbol", "base14"), ("", "auto")]


@query(f"SELECT font, mode, CASE WHEN mode <> 'helvetica' AND font IN ({', '.join(map(_quoted, geometry.BASE_FONTS))}) THEN font ELSE 'Helvetica' END AS mapped FROM {_values(_FONTS, 'font, mode')}")
def map_font(spark, d):
    return spark.createDataFrame(_FONTS, "font string, mode string").withColumn("mapped", geometry.base_font(F.col("font"), F.col("mode")))


@query("SELECT doc_id, CAST(n_chars % 16777216 AS INT) AS color, (n_chars % 16777216) // 65536 AS red, (n_chars // 256) % 256 AS green, n_chars % 256 AS blue FROM (SELECT doc_id, n_chars * 7919 AS n_chars FROM documents)")
def rgb(spark, d):
    rows = _docs(spark, d).select("doc_id", (F.col("n_chars") * 7919 % 16777216).cast("int").alias("color"))
    c = geometry.rgb(F.col("color"))
    return rows.select("doc_id", "color", *(F.get(c, F.lit(k)).cast("long").alias(n) for k, n in enumerate(("red", "green", "blue"))))


_SPANS = f"{_WORDS}, {_matches_sql(['Email', 'IPAddress', 'Secret'])}, hits AS (SELECT w.*, e.\"offset\" AS span_id FROM words w JOIN ents e ON w.doc_id = e.doc_id AND w.\"offset\" < e.\"offset\" + e.length AND w.\"offset\" + length(word) > e.\"offset\")"


def _span_hits(spark: SparkSession, d: str) -> DataFrame:
    found = entities.recognise(_docs(spark, d), ["Email", "IPAddress", "Secret"]).withColumn("span_id", F.col("offset"))
    return spans.span_words(_words(spark, d), found)


@query(f"WITH {_SPANS} SELECT doc_id, span_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_words FROM hits GROUP BY 1, 2, 3")
def span_boxes(spark, d):
    return spans.boxes(_span_hits(spark, d), ["doc_id", "span_id", "page"])


_RUNS = "o AS (SELECT *, round_even(y0, 0) AS bucket FROM chosen), g AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > 0.75 * (lag(y1) OVER w - lag(y0) OVER w) THEN 1 ELSE 0 END AS br FROM o WINDOW w AS (PARTITION BY doc_id, page, bucket ORDER BY x0, x1, y0, y1)), r AS (SELECT *, sum(br) OVER (PARTITION BY doc_id, page, bucket ORDER BY x0, x1, y0, y1) AS run FROM g)"


@query(f"WITH {_WORDS}, chosen AS (SELECT * FROM words WHERE length(word) % 4 <> 0), {_RUNS} SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_words FROM r GROUP BY doc_id, page, bucket, run")
def merge_rects(spark, d):
    return spans.merge_rectangles(_words(spark, d).where(F.length("word") % 4 != 0), ["doc_id", "page"])


@query()
def locate_findings(spark, d):
    found = entities.recognise(_docs(spark, d), ["Email", "IPAddress", "Secret"])
    w = _words(spark, d)
    at = spans.span_words(w, found.withColumn("span_id", F.col("offset"))).groupBy("doc_id", "span_id").agg(F.min("page").alias("page"))
    findings = found.join(at.withColumnRenamed("span_id", "offset"), ["doc_id", "offset"]).select("doc_id", "page", F.col("offset").cast("long").alias("finding_id"), "text")
    pages = w.join(findings.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    return spans.locate(pages, findings)


_LAID = f"{_LINES}, laid AS (SELECT doc_id, CAST(line_idx // 60 AS INT) AS page, line_idx, line, (line_idx % 60) * 12.0::DOUBLE AS y0, (line_idx % 60) * 12.0::DOUBLE + 10 AS y1 FROM lines)"


def _laid(df: DataFrame) -> DataFrame:
    top = F.col("line_idx") % spans.PAGE_LINES * spans.LINE
    return df.select("doc_id", F.floor(F.col("line_idx") / spans.PAGE_LINES).cast("int").alias("page"), "line_idx", "line", top.alias("y0"), (top + spans.HEIGHT).alias("y1"))


_BAND = "rects AS (SELECT doc_id, page, min(y0) + 12 AS top, min(y0) + 30 AS bottom FROM laid GROUP BY 1, 2)"


@query(f"WITH {_LAID}, {_BAND}, j AS (SELECT laid.*, top, bottom, NOT (y1 < top - 1.5 OR y0 > bottom + 1.5) AS hit FROM laid JOIN rects USING (doc_id, page)), cut AS (SELECT doc_id, page, min(y0) AS f, CASE WHEN max(y1) - min(y0) < 0.5 THEN min(bottom) - min(top) ELSE max(y1) - min(y0) END AS h FROM j WHERE hit GROUP BY 1, 2) SELECT j.doc_id, j.page, line_idx, y0 - CASE WHEN y0 > f THEN h ELSE 0 END AS y0, y1 - CASE WHEN y0 > f THEN h ELSE 0 END AS y1 FROM j LEFT JOIN cut ON cut.doc_id = j.doc_id AND cut.page = j.page WHERE NOT hit")
def reflow_lines(spark, d):
    laid = _laid(paragraphs.lines(_docs(spark, d)))
    rects = laid.groupBy("doc_id", "page").agg((F.min("y0") + 12).alias("top"), (F.min("y0") + 30).alias("bottom"))
    return reflow.reflow(laid, rects)


@query()
def reflow_sequence(spark, d):
    laid = _laid(paragraphs.lines(_docs(spark, d)))
    one = laid.groupBy("doc_id", "page").agg(F.min("y0").alias("y"))
    rects = one.select("doc_id", "page", (F.col("y") + 12).alias("top"), (F.col("y") + 20).alias("bottom")).unionAll(one.select("doc_id", "page", F.col("y") + 60, F.col("y") + 80))
    return reflow.reflow_all(laid, rects)


@query(f"WITH {_LAID} SELECT doc_id, page, min(y0) AS min_y, max(y1) AS max_y, count(*) AS n_lines FROM laid WHERE trim(line) <> '' GROUP BY 1, 2")
def page_extent(spark, d):
    laid = _laid(_paras(spark, d))
    return laid.groupBy("doc_id", "page").agg(F.min("y0").alias("min_y"), F.max("y1").alias("max_y"), F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {_WORDS} SELECT doc_id, page, y0, min(x0) AS x0, max(x1) AS x1 FROM words GROUP BY 1, 2, 3 HAVING max(y1) - y0 < 14 AND max(x1) - min(x0) > 306")
def page_separators(spark, d):
    """Flat drawings over half a page wide; here, full lines of words stand for them."""
    w = _words(spark, d).groupBy("doc_id", "page", "y0").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return w.where((F.col("y1") - F.col("y0") < 14) & (F.col("x1") - F.col("x0") > 612 / 2)).select("doc_id", "page", "y0", "x0", "x1")


_TLINES = f"{_THREADS}, tl AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS line_idx, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM threads)), laid AS (SELECT doc_id, CAST(line_idx // 60 AS INT) AS page, line_idx, line, (line_idx % 60) * 12.0::DOUBLE AS y0, (line_idx % 60) * 12.0::DOUBLE + 10 AS y1 FROM tl)"
_BANDS = f"{_TLINES}, nx AS (SELECT *, lead(y0) OVER (PARTITION BY doc_id, page ORDER BY line_idx) AS nt FROM laid), hd AS (SELECT *, line_idx - row_number() OVER (PARTITION BY doc_id, page ORDER BY line_idx) AS run FROM nx WHERE regexp_matches(trim(line), '{reflow.HEADER_LINES}')), bands AS (SELECT doc_id, page, min(line_idx) AS first_line, max(line_idx) AS last_line, min(y0) AS top, greatest(max(y1), max(nt)) AS bottom FROM hd GROUP BY doc_id, page, run)"


def _thread_lines(spark: SparkSession, d: str) -> DataFrame:
    return _laid(paragraphs.lines(threads(table(spark, d, "conversations"))))


@query(f"WITH {_TLINES} SELECT doc_id, line_idx, line FROM laid WHERE regexp_matches(trim(line), '{reflow.HEADER_LINES}')")
def header_lines(spark, d):
    return _thread_lines(spark, d).where(F.trim("line").rlike(reflow.HEADER_LINES)).select("doc_id", "line_idx", "line")


@query(f"WITH {_BANDS} SELECT * FROM bands")
def consecutive_groups(spark, d):
    return reflow.header_bands(_thread_lines(spark, d))


@query(f"WITH {_BANDS} SELECT l.doc_id, l.page, line_idx, y0 - coalesce((SELECT sum(bottom - top) FROM bands b WHERE b.doc_id = l.doc_id AND b.page = l.page AND b.top <= l.y0), 0) AS y0, y1 - coalesce((SELECT sum(bottom - top) FROM bands b WHERE b.doc_id = l.doc_id AND b.page = l.page AND b.top <= l.y0), 0) AS y1 FROM laid l WHERE NOT EXISTS (SELECT 1 FROM bands b WHERE b.doc_id = l.doc_id AND b.page = l.page AND l.line_idx BETWEEN first_line AND last_line)")
def collapse_gaps(spark, d):
    laid = _thread_lines(spark, d)
    return reflow.collapse(laid, reflow.header_bands(laid))


# review -------------------------------------------------------------------------------------------
_SUGG = f"{_SPANS}, sugg AS (SELECT h.doc_id, CAST(h.doc_id AS VARCHAR) || '_' || h.span_id AS id, min(h.page) AS page, min(h.x0) AS x0, min(h.y0) AS y0, max(h.x1) AS x1, max(h.y1) AS y1 FROM hits h GROUP BY h.doc_id, h.span_id), s2 AS (SELECT sugg.*, e.text, e.category FROM sugg JOIN ents e ON sugg.doc_id = e.doc_id AND sugg.id = CAST(e.doc_id AS VARCHAR) || '_' || e.\"offset\"), appr AS (SELECT id, ascii(substr(md5(id), 1, 1)) % 2 = 0 AS approved FROM sugg WHERE substr(md5(id), 2, 1) <> '0')"


def _suggestions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = entities.recognise(_docs(spark, d), ["Email", "IPAddress", "Secret"]).withColumn("span_id", F.col("offset"))
    hits = spans.span_words(_words(spark, d), found.drop("text", "category"))
    box = hits.groupBy("doc_id", "span_id").agg(F.min("page").alias("page"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    rows = box.join(found.select("doc_id", "span_id", "text", "category"), ["doc_id", "span_id"]).withColumn("id", F.concat_ws("_", "doc_id", "span_id"))
    approvals = rows.select("id", (F.ascii(F.substring(F.md5("id"), 1, 1)) % 2 == 0).alias("approved")).where(F.substring(F.md5("id"), 2, 1) != "0")
    return rows, approvals


@query(f"WITH {_SUGG} SELECT text, count(*) AS n_instances, min(category) AS category, bool_and(coalesce(approved, false)) AS all_approved FROM s2 LEFT JOIN appr USING (id) GROUP BY text")
def suggestion_groups(spark, d):
    return review.grouped(*_suggestions(spark, d))


@query(f"WITH {_SUGG} SELECT doc_id, page, count(DISTINCT (y0, x0, y1, x1)) AS n_rects, min(y0) AS first_y, max(x1) AS last_x FROM (SELECT s2.doc_id, page, x0, y0, x1, y1 FROM s2 JOIN appr USING (id) WHERE approved UNION ALL SELECT doc_id, page, 0, y0, 612, y1 FROM s2 WHERE category = 'Secret') GROUP BY 1, 2")
def review_areas(spark, d):
    rows, approvals = _suggestions(spark, d)
    drawn = rows.where("category = 'Secret'").withColumn("x0", F.lit(0.0)).withColumn("x1", F.lit(612.0))
    out = review.areas(rows, approvals, [drawn])
    return out.select("doc_id", "page", F.size("rects").cast("long").alias("n_rects"), F.array_min(F.col("rects.y0")).alias("first_y"), F.array_max(F.col("rects.x1")).alias("last_x"))


@query(f"WITH {_SUGG} SELECT page, doc_id, array_to_string(list(CAST(y0 AS INT)::VARCHAR || ':' || CAST(x0 AS INT)::VARCHAR ORDER BY y0, x0), ',') AS ops FROM (SELECT DISTINCT doc_id, page, x0, y0, x1, y1 FROM s2) GROUP BY 1, 2")
def ops_by_page(spark, d):
    rows, _ = _suggestions(spark, d)
    packed = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set(F.struct("y0", "x0", "y1", "x1"))).alias("r"))
    return packed.select("doc_id", "page", F.array_join(F.transform("r", lambda r: F.concat(r["y0"].cast("int").cast("string"), F.lit(":"), r["x0"].cast("int").cast("string"))), ",").alias("ops"))


@query(f"WITH {_SUGG}, n AS (SELECT doc_id, max(page) AS last FROM words GROUP BY doc_id), asked AS (SELECT doc_id, id, page + CAST(split_part(id, '_', 2) AS INT) % 3 AS page FROM s2) SELECT doc_id, id, page, page <= last AS is_applied FROM asked JOIN n USING (doc_id)")
def redaction_apply(spark, d):
    """Areas with whether their page exists; some of the suggestions' are moved past their document's end."""
    rows, _ = _suggestions(spark, d)
    pages = _words(spark, d).groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    asked = rows.select("doc_id", "id", (F.col("page") + F.col("span_id") % 3).alias("page"))
    return review.applied(asked, pages)


_NEEDLES = "needles AS (SELECT doc_id, lower(regexp_replace(word, '[.,;:!?''’s()]+$', '')) AS key FROM words WHERE line_idx = 0 AND word_idx = 0)"


@query(f"WITH {_WORDS}, {_NEEDLES}, k AS (SELECT *, regexp_replace(lower(word), '[.,;:!?''’s()]+$', '') AS key FROM words) SELECT DISTINCT k.doc_id, 'promo_' || k.key || '_' || page || '_' || line_idx || '_' || word_idx AS id, page, line_idx, word_idx, word FROM k JOIN needles n ON k.doc_id = n.doc_id AND k.key = n.key")
def redact_all_occurrences(spark, d):
    w = _words(spark, d)
    first = w.where("line_idx = 0 and word_idx = 0")
    needles = first.select("doc_id", F.lower(F.regexp_replace("word", r"[.,;:!?'’s()]+$", "")).alias("text"))
    return review.occurrences(w, needles)


# images and events --------------------------------------------------------------------------------
_IMAGE = "img AS (SELECT customer.c_custkey % 50 AS image_id, CAST(c_custkey // 50 AS INT) AS row, list_transform(range(8), lambda i: CASE WHEN (c_custkey * 7 + i * 13) % 11 < 9 OR (c_custkey // 50) % 5 > 1 THEN 255 ELSE (c_custkey * 31 + i) % 256 END) AS pixels FROM customer)"


def _images(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    white = lambda i: ((key * 7 + i * 13) % 11 < 9) | (F.floor(key / 50) % 5 > 1)
    pixels = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(white(i), F.lit(255)).otherwise(((key * 31 + i) % 256).cast("int")))
    return table(spark, d, "customer").select((key % 50).alias("image_id"), F.floor(key / 50).cast("int").alias("row"), pixels.alias("pixels"))


_PROFILE = f"{_IMAGE}, prof AS (SELECT image_id, row, list_sum(pixels)::DOUBLE / len(pixels) AS mean, list_sum(pixels)::DOUBLE / len(pixels) >= 245 AS is_white FROM img)"


@query(f"WITH {_PROFILE} SELECT * FROM prof")
def row_profile(spark, d):
    return raster.row_profile(_images(spark, d))


@query(f"WITH {_PROFILE} SELECT image_id, min(row) AS first_row, max(row) AS last_row FROM prof WHERE NOT is_white GROUP BY image_id")
def content_extent(spark, d):
    return raster.content_extent(raster.row_profile(_images(spark, d)))


@query(f"WITH {_PROFILE}, r AS (SELECT *, row - row_number() OVER (PARTITION BY image_id ORDER BY row) AS g FROM prof WHERE is_white), runs AS (SELECT image_id, min(row) AS a, max(row) AS b FROM r GROUP BY image_id, g HAVING max(row) - min(row) + 1 >= 3), c AS (SELECT image_id, CAST((a + b) // 2 AS INT) AS cut FROM runs), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY abs(cut - 12), cut) AS n FROM c) SELECT image_id, 12 AS target, cut FROM k WHERE n = 1")
def white_cuts(spark, d):
    images = _images(spark, d)
    targets = images.select("image_id").distinct().withColumn("target", F.lit(12))
    return raster.white_cuts(raster.row_profile(images), targets)


@query("SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_props(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


@query()
def fuzzy_documents(spark, d):
    """Documents of a language with a near length and ``WORDS_SHARED`` of their distinct words in common, and how much of the first
    the second covers. Sources are the first documents of their texts; targets are all documents of the other text."""
    return fuzzy.near_documents(_docs(spark, d), WORDS_SHARED)


# joins between messages, lines, rectangles and labels ----------------------------------------------
@query(f"WITH {_EPAIRS} SELECT doc_id, email_idx, body FROM blocks b WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = b.doc_id AND p.target_email_index = b.email_idx AND contains(tn, sn))")
def email_duplicate_targets(spark, d):
    b = _blocks(spark, d)
    return email.targets(b, email.contained(b)).select("doc_id", "email_idx", "body")


@query(f"WITH {_TLINES}, lo AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS o FROM laid), pieces AS (SELECT doc_id, unnest(range(len(p))) AS n, unnest(p) AS piece FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^From: ', chr(1) || 'From: ', 'g'), chr(1)) AS p FROM threads)), sp AS (SELECT doc_id, n, CAST(n - 1 AS INT) AS email_idx, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(piece) AS size FROM pieces) SELECT lo.doc_id, email_idx, page, min(y0) AS y0, max(y1) AS y1, count(*) AS n_lines FROM lo JOIN sp ON lo.doc_id = sp.doc_id AND n > 0 AND o < a + size AND o + length(line) > a GROUP BY 1, 2, 3")
def email_line_boxes(spark, d):
    """The band of each message on each page: lines whose span overlaps the message's."""
    made = threads(table(spark, d, "conversations"))
    lines = paragraphs.lines(made)
    laid = _laid(lines).join(lines.select("doc_id", "line_idx", F.col("offset").alias("o")), ["doc_id", "line_idx"])
    both = laid.join(email.clean_spans(made), "doc_id").where((F.col("o") < F.col("offset") + F.col("length")) & (F.col("o") + F.length("line") > F.col("offset")))
    return both.groupBy("doc_id", "email_idx", "page").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {_WORDS} SELECT doc_id, page, count(*) AS n_words FROM words WHERE x0 < 200 - 0.5 AND x1 > 100 + 0.5 AND y0 < 46 - 0.5 AND y1 > 24 + 0.5 GROUP BY 1, 2")
def rect_intersections(spark, d):
    w = _words(spark, d)
    bands = w.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(100.0).alias("left"), F.lit(24.0).alias("top"), F.lit(200.0).alias("right"), F.lit(46.0).alias("bottom"))
    return spans.intersecting(w, bands, ["doc_id", "page"]).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_words"))


_LRECT = f"{_WORDS}, lr AS (SELECT doc_id, page, line_idx, string_agg(word, ' ' ORDER BY word_idx) AS line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY 1, 2, 3)"


@query(f"WITH {_LRECT} SELECT * FROM lr WHERE trim(line) <> '' AND y1 - y0 >= 2")
def styled_lines(spark, d):
    return spans.line_rectangles(_words(spark, d))


@query(f"WITH {_LRECT} SELECT doc_id, page, line_idx, lead(y0) OVER (PARTITION BY doc_id, page ORDER BY y0) - y1 AS gap FROM lr")
def next_block_gap(spark, d):
    return spans.next_gap(spans.line_rectangles(_words(spark, d))).select("doc_id", "page", "line_idx", "gap")


@query(f"WITH {_LRECT}, dup AS ({_PDUP.removeprefix(f'WITH {_LINES}, ').replace('h AS (', 'SELECT * FROM (WITH h AS (', 1)})), k AS (SELECT dup.doc_id, dup.line_idx, row_number() OVER (PARTITION BY dup.doc_id ORDER BY dup.line_idx) AS n FROM dup) SELECT lr.doc_id, page, 'EXACT #' || n AS label, x0 / 612 * 612 AS x0, y0 / 792 * 792 AS y0, x1 / 612 * 612 AS x1, y1 / 792 * 792 AS y1 FROM k JOIN lr USING (doc_id, line_idx)")
def duplicate_annotations(spark, d):
    """Labelled rectangles of repeated lines, from boxes relative to their pages."""
    found = paragraph_duplicates(spark, d)
    numbered = found.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_idx")))
    rects = spans.line_rectangles(_words(spark, d))
    pages = rects.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    relative = [geometry.relative(F.col(c), F.lit(612.0 if c[0] == "x" else 792.0)).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")]
    boxes = numbered.join(rects, ["doc_id", "line_idx"]).select("doc_id", "page", F.lit("exact").alias("kind"), "number", F.lit(1.0).alias("similarity"), *relative)
    return annotations(boxes, pages)


@query(f"WITH {_WORDS}, {_NEEDLES}, k AS (SELECT *, regexp_replace(lower(word), '[.,;:!?''’s()]+$', '') AS key FROM words), occ AS (SELECT DISTINCT k.doc_id, 'promo_' || k.key || '_' || page || '_' || line_idx || '_' || word_idx AS id, line_idx FROM k JOIN needles n ON k.doc_id = n.doc_id AND k.key = n.key) SELECT doc_id, id FROM occ WHERE line_idx = 0")
def undo_promotions(spark, d):
    """What is left of the spread redactions after those outside the first line are undone."""
    found = redact_all_occurrences(spark, d)
    return review.undo(found, found.where("line_idx > 0")).select("doc_id", "id")

"""Entities: recognise by rule, validate by context, link to owners, filter by exceptions, mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import around

#: Words before a date that make it a date of birth, and words that make an organisation a school.
BIRTH_WORDS = ("dob", "d.o.b", "date of birth", "born")
SCHOOL_WORDS = ("school", "academy", "college", "university", "nursery", "kindergarten")


def _named(category: str, found: Column) -> Column:
    part = lambda m: F.struct(F.lit(category).alias("category"), m["text"].alias("text"), m["offset"].alias("offset"), m["length"].alias("length"))
    return F.transform(F.coalesce(found, F.array()), part)


def recognise(docs: DataFrame, categories: list[str] | None = None, key: str | list[str] = "doc_id", text_col: str = "text", patterns: dict[str, str] = rules.PATTERNS, content: bool = False) -> DataFrame:
    """The key (``doc_id``), ``category``, ``text``, ``offset`` and ``length`` of every rule match, in one pass over the texts; with
    ``content``, the searched text too."""
    keys = [key] if isinstance(key, str) else key
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "\x01", " ")
    chosen = [(c, p) for c, p in patterns.items() if categories is None or c in categories]
    kept = [*keys, "content"] if content else keys
    # the pieces are columns of their own, so that a text is cut once per rule and not once per match
    cut = docs.select(*keys, text.alias("content")).select(*kept, *(rules.pieces(F.col("content"), p, rules.HOLDS.get(c, "")).alias(f"p{k}") for k, (c, p) in enumerate(chosen)))
    found = [_named(c, rules.matches(F.col(f"p{k}"))) for k, (c, _) in enumerate(chosen)]
    rows = cut.select(*kept, F.explode(F.concat(*found)).alias("m")).select(*kept, "m.*")
    return rows.where(rules.is_valid(F.col("category"), F.col("text")))


def validate(entities: DataFrame) -> DataFrame:
    """Entities with their ``content``: dates count only after a birth word (as ``DateOfBirth``), organisations only
    if they name a school (as ``School``); all others stay. ``is_kept`` tells, ``final_category`` names."""
    before = F.lower(around(F.col("content"), F.col("offset"), 20, 0))
    born, school = F.lit(False), F.lit(False)
    for w in BIRTH_WORDS:
        born = born | before.contains(w)
    for w in SCHOOL_WORDS:
        school = school | F.lower("text").contains(w)
    kept = F.when(F.col("category") == "DateTime", born).when(F.col("category") == "Organization", school).otherwise(F.lit(True))
    name = F.when(F.col("category") == "DateTime", F.lit("DateOfBirth")).when(F.col("category") == "Organization", F.lit("School")).otherwise(F.col("category"))
    return entities.withColumn("is_kept", kept).withColumn("final_category", name)


def linking_needed(entities: DataFrame, any_exceptions: bool = True, key: str | list[str] = "doc_id") -> DataFrame:
    """The key (``doc_id``) and ``is_needed``: whether a chunk has a person and another category, and exceptions exist."""
    person = F.col("category") == "Person"
    return entities.groupBy(key).agg((F.bool_or(person) & F.bool_or(~person) & F.lit(any_exceptions)).alias("is_needed"))


def sole_owners(entities: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """Links by rule, the default where no model links: ``owner`` of every text of a chunk that names exactly one person."""
    keys = [key] if isinstance(key, str) else key
    person = F.when(F.col("category") == "Person", F.col("text"))
    one = entities.groupBy(keys).agg(F.min(person).alias("owner"), F.max(person).alias("other")).where("owner = other").drop("other")
    return entities.select(*keys, "text").distinct().join(one, keys)


def without_exceptions(entities: DataFrame, exceptions: DataFrame, links: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """Findings: entities less those excepted. Where a document needs linking, an entity goes if its owner is
    excepted; elsewhere, if its own text is. ``exceptions(value)`` is lower-case, ``links`` has the key, ``text`` and ``owner``."""
    keys = [key] if isinstance(key, str) else key
    needed = linking_needed(entities, key=keys)
    owner = links.select(*keys, "text", F.lower("owner").alias("owner"))
    rows = entities.join(needed, keys).join(owner, [*keys, "text"], "left")
    rows = rows.withColumn("tested", F.when(F.col("is_needed"), F.col("owner")).otherwise(F.lower("text")))
    left = rows.join(exceptions.select(F.col("value").alias("tested")).distinct(), "tested", "left_anti")
    return left.select(*entities.columns, F.concat(F.lit("Identified as sensitive PII ("), "category", F.lit(").")).alias("reasoning"))


def findings(chunks: DataFrame, exceptions: DataFrame, links: DataFrame | None = None, others: DataFrame | None = None, key: str | list[str] = "doc_id") -> DataFrame:
    """All steps from chunks to findings: recognise by rule (``others`` adds a model's entities: the key, ``category``, ``text``,
    ``offset``, ``length`` and the chunk's ``content``), validate by context, link to owners (:func:`sole_owners` unless ``links`` are
    given), drop what is excepted. The key, ``text``, the final ``category``, ``offset``, ``length`` and ``reasoning``. Null and empty
    texts have no findings."""
    keys = [key] if isinstance(key, str) else key
    found = recognise(chunks, key=keys, patterns=rules.PATTERNS | rules.NAME_PATTERNS, content=True)
    if others is not None:
        found = found.unionByName(others.select(found.columns))
    kept = validate(found).where("is_kept").drop("is_kept", "content")
    left = without_exceptions(kept, exceptions, links if links is not None else sole_owners(kept, keys), keys)
    return left.select(*keys, "text", F.col("final_category").alias("category"), "offset", "length", F.concat(F.lit("Identified as sensitive PII ("), "final_category", F.lit(").")).alias("reasoning"))


def statistics(entities: DataFrame) -> DataFrame:
    """Count, distinct texts and lengths by category."""
    return entities.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_texts"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.bround(F.avg("length"), 3).alias("avg_length"),
    )


def redact(docs: DataFrame, entities: DataFrame, mask: str = "█") -> DataFrame:
    """``doc_id``, ``text`` with every character under an entity masked, and ``n_masked``. Overlapping spans are merged first."""
    spans = entities.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("offset", (F.col("offset") + F.col("length")).alias("stop")))).alias("spans"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(spans, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array()))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("masked"))

    def step(acc, s):
        low, high = F.greatest(acc["at"], s["offset"]), F.greatest(acc["at"], s["stop"])
        return F.struct(
            F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, low - acc["at"]), F.repeat(F.lit(mask), high - low)).alias("out"),
            high.alias("at"), (acc["masked"] + high - low).alias("masked"),
        )

    done = F.aggregate("spans", start, step)
    rows = rows.select("doc_id", "text", done.alias("d"))
    return rows.select("doc_id", F.concat("d.out", F.substring(F.col("text"), F.col("d.at") + 1, F.length("text"))).alias("text"), F.col("d.masked").alias("n_masked"))


def unmapped(findings: DataFrame, mapped: DataFrame) -> DataFrame:
    """Bag difference of texts: findings that no suggestion was located for, with how often."""
    return findings.select("text").exceptAll(mapped.select("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n_unmapped"))

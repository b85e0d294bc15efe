"""Entities named in texts, from a dictionary of any size.

The dictionary is a table of names.  A text's words are looked up in it in three steps, each cheaper than what it spares:

1. a bit table of fixed size over the hashed first words (one word for one-word names, two for longer ones) says inside the row
   at which words a name can begin; a wrong yes only costs a lookup;
2. the word sequences that begin there are joined with the names by an equi-join, so a dictionary too large to broadcast is
   shuffled like any other table;
3. the few names left per text are settled by columns in the row: exact place of the first whole-word occurrence, context,
   exclusions, and the longest of nested spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import fixed_values as fv
from newsloom.functions import ids
from newsloom.functions.text import contains_any, fold
from newsloom.session import cut

_S = T.StringType()
ENTITY_HIT = T.StructType(
    [
        T.StructField("canonical_id", _S),
        T.StructField("matched_text", _S),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("status", _S),
        T.StructField("rule", _S),
        T.StructField("official_host", T.BooleanType()),
        T.StructField("parent", _S),
        T.StructField("excluded_context", T.ArrayType(_S)),
    ]
)
#: One row per name: the entity with its place in the dictionary, and the name with its kind and its place in the entity.
NAMES = T.StructType(
    [
        T.StructField("entity", _S),
        T.StructField("entity_place", T.LongType()),
        T.StructField("kind", _S),  # name, symbol or excluded
        T.StructField("place", T.LongType()),
        T.StructField("name", _S),
        T.StructField("conditional", T.BooleanType()),
        T.StructField("parent", _S),
        T.StructField("domains", T.ArrayType(_S)),
        T.StructField("exchange", _S),
    ]
)
_WORD = r"[\p{L}\p{N}_]"
#: Bits of the table of first words: 4,096 longs, whatever the dictionary.
BITS = 1 << 18


def name_rows(spark: SparkSession, entities: list[dict]) -> DataFrame:
    """The names table of entity records: aliases and former names (longer ones first), ticker symbol, excluded phrases."""
    rows = []
    for n, e in enumerate(entities):
        names = sorted([*(e.get("aliases") or []), *(e.get("legacy_names") or [])], key=lambda x: -len(x.split()))
        ticker = e.get("ticker") or {}
        kinds = [("name", names), ("symbol", [ticker["symbol"]] if ticker.get("symbol") else []), ("excluded", e.get("excluded_contexts") or [])]
        conditional = not set(fv.CONDITIONAL_ENTITY_RULES).isdisjoint(e.get("ambiguity_rules") or [])
        fixed = (conditional, e.get("parent"), e.get("official_domains") or [], (ticker.get("exchange") or "").lower())
        rows += [(e["canonical_id"], n, kind, place, name, *fixed) for kind, own in kinds for place, name in enumerate(own)]
    return spark.createDataFrame(rows, NAMES)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(fold(text), "ς", "σ"), F.lit(f"{_WORD}+"), F.lit(0))


def _slot(*words: Column) -> Column:
    return F.xxhash64(*words).bitwiseAND(F.lit(BITS - 1))


def _bit_table(first: DataFrame) -> list[int]:
    """The slots of ``first`` as longs; at most BITS / 64 rows reach the driver."""
    word = F.shiftright("slot", 6)
    bits = first.groupBy(word.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits")).collect()
    table = [0] * (BITS // 64)
    for r in bits:
        table[r["at"]] = r["bits"]
    return table


def _in_table(table: list[int], slot: Column) -> Column:
    """Whether a slot is set; the table is one constant of the plan."""
    longs = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    return F.getbit(F.get(longs, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def _sequences(words: Column, one: list[int], two: list[int], lengths: list[int]) -> Column:
    """Distinct word sequences of a text that can be names."""
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    single = F.filter(F.array_distinct(words), lambda w: _in_table(one, _slot(w)))
    starts = F.filter(places, lambda i: _in_table(two, _slot(F.get(words, i), F.get(words, i + 1))))
    longer = F.flatten(F.transform(starts, lambda i: F.array(*[F.array_join(F.slice(words, i + 1, F.lit(n)), " ") for n in lengths]))) if lengths else F.array().cast("array<string>")
    return F.array_distinct(F.concat(single, longer))


def named_in(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, names): the dictionary rows whose words occur one after the other in a text; separators are not looked at yet.

    A list holds at most the names that one text contains.
    """
    indexed = cut(names.withColumn("_w", _words(F.col("name"))).filter(F.size("_w") > 0).select("*", F.array_join("_w", " ").alias("sequence"), F.size("_w").alias("n_words")), "names")
    one = _bit_table(indexed.filter("n_words = 1").select(_slot(F.get("_w", F.lit(0))).alias("slot")))
    two = _bit_table(indexed.filter("n_words > 1").select(_slot(F.get("_w", F.lit(0)), F.get("_w", F.lit(1))).alias("slot")))
    lengths = sorted(r[0] for r in indexed.filter("n_words > 1").select("n_words").distinct().collect())
    # The outer form: the inner one would work the sequences out once more to drop texts without any, which the join drops.
    found = docs.select(key, _words(F.col(text)).alias("_words")).select(key, F.explode_outer(_sequences(F.col("_words"), one, two, lengths)).alias("sequence"))
    candidate = F.struct(*[F.col(c) for c in NAMES.fieldNames()])
    return found.join(indexed.drop("_w", "n_words"), "sequence").groupBy(key).agg(F.collect_list(candidate).alias("names"))


def _pattern(name: Column, exact: Column) -> Column:
    """The name as whole words.  It is looked for ahead first: most places end at its first letter, before the slower look behind."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.when(exact, "").otherwise("(?iu)"), F.lit("(?="), quoted, F.lit(f")(?<!{_WORD})"), quoted, F.lit(f"(?!{_WORD})"))


def _located(text: Column, names: Column) -> Column:
    """The candidates that occur as whole words, with pattern and place (in characters) of the first occurrence, in dictionary order."""

    def split_at(c):
        pattern = _pattern(c["name"], c["kind"] == "symbol")
        return F.struct(c.alias("c"), pattern.alias("pattern"), F.split(text, pattern, 2).alias("parts"))

    def placed(x):
        c = x["c"]
        return F.struct(
            c["entity_place"].alias("entity_place"), (c["kind"] == "symbol").alias("symbol"), c["place"].alias("place"), c["kind"].alias("kind"), c.alias("c"), x["pattern"].alias("pattern"),
            F.char_length(F.get(x["parts"], F.lit(0))).alias("start"),
        )

    return F.array_sort(F.transform(F.filter(F.transform(names, split_at), lambda x: F.size(x["parts"]) > 1), placed))


def _sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def _near(sentences: Column, pattern: Column, missing: Column) -> Column:
    """The first sentence with the name, in lower case."""
    return F.lower(F.coalesce(F.get(F.filter(sentences, lambda s: F.rlike(s, pattern)), F.lit(0)), missing))


def _subjects(located: Column, text: Column, sentences: Column) -> Column:
    """The first name found of each entity, else its symbol, with the sentence around it where the rules ask for one."""
    names = F.filter(located, lambda p: p["kind"] != "excluded")
    bound = F.transform(F.array(names), lambda a: F.filter(a, lambda p, i: (i == 0) | (F.get(a, i - 1)["entity_place"] != p["entity_place"])))

    def heard(p):
        several = F.size(F.split(F.btrim(p["c"]["name"]), r"\s+")) > 1
        missing = F.when(p["symbol"], "").otherwise(text)
        around = F.when(p["symbol"] | (p["c"]["conditional"] & ~several), _near(sentences, p["pattern"], missing))
        return F.struct(p.alias("p"), several.alias("several"), around.alias("around"))

    return F.transform(F.get(bound, F.lit(0)), heard)


def _hits(text: Column, host: Column, subjects: Column, phrases: Column) -> Column:
    """One hit per subject, excluded if a phrase of its entity is in the text."""

    def judged(s):
        c = s["p"]["c"]
        official = F.coalesce(F.exists(c["domains"], lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))), F.lit(False))
        against = F.transform(F.filter(phrases, lambda x: x["entity_place"] == s["p"]["entity_place"]), lambda x: x["c"]["name"])
        return F.struct(s.alias("s"), official.alias("official"), against.alias("against"))

    def settled(j):
        s, official, against = j["s"], j["official"], j["against"]
        p, c = s["p"], s["p"]["c"]
        named = ~c["conditional"] | official | s["several"] | contains_any(s["around"], fv.CREDIT_CONTEXT)
        traded = F.contains(s["around"], c["exchange"]) | contains_any(s["around"], fv.TICKER_CONTEXT)
        sure = F.when(p["symbol"], traded).otherwise(named)
        length = F.char_length(c["name"])
        values = {
            "canonical_id": c["entity"], "matched_text": F.substring(text, p["start"] + 1, length), "start": p["start"], "end": p["start"] + length,
            "status": F.when(F.size(against) > 0, "excluded").when(sure, "resolved").otherwise("ambiguous"),
            "rule": F.when(p["symbol"], "ER04").when(c["conditional"], "/".join(fv.CONDITIONAL_ENTITY_RULES)).otherwise("ER01"),
            "official_host": official, "parent": F.when(~p["symbol"], c["parent"]), "excluded_context": F.when(F.size(against) > 0, against),
        }
        return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in ENTITY_HIT.fields])

    return F.transform(F.transform(subjects, judged), settled)


def suppress_inner_names(hits: Column) -> Column:
    """A hit whose span lies inside a longer hit's span is kept as evidence, not as a subject."""

    def covering(h):
        return F.filter(
            hits,
            lambda o: (o["start"] <= h["start"]) & (h["end"] <= o["end"]) & (o["end"] - o["start"] > h["end"] - h["start"]),
        )

    def settle(h):
        over = F.get(covering(h), F.lit(0))["canonical_id"]
        return F.struct(
            *[h[f].alias(f) for f in ENTITY_HIT.fieldNames() if f != "status"],
            F.when(over.isNotNull(), "suppressed_by_longer_name").otherwise(h["status"]).alias("status"),
            over.alias("suppressed_by"),
        )

    return F.transform(hits, settle)


def with_entities(df: DataFrame, key: str, text: str, url: str, entities: DataFrame | list[dict], out: str = "entity_matches") -> DataFrame:
    """Entities named in a text as an array of hits: one per entity, in dictionary order, names inside longer names marked.

    ``key`` names the rows (unique); ``entities`` is a names table or a list of entity records.  Rows that name nobody, or whose
    text is null, have an empty array.
    """
    names = name_rows(df.sparkSession, entities) if isinstance(entities, list) else entities
    found = named_in(df, key, text, names).withColumnRenamed(key, "_key")
    joined = df.join(found, F.col(key) == F.col("_key"), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    kind = T.ArrayType(T.StructType([*[f for f in ENTITY_HIT.fields if f.name != "status"], ENTITY_HIT["status"], T.StructField("suppressed_by", _S)]))
    # Each step hands its arrays on as a lambda's variable: a column would be written out, and worked out again, wherever it is named.
    read = F.struct(_located(body, F.col("names")).alias("at"), _sentences(body).alias("sentences"), F.coalesce(ids.host(F.col(url)), F.lit("")).alias("host"))
    heard = F.transform(
        F.array(read),
        lambda x: F.struct(_subjects(x["at"], body, x["sentences"]).alias("subjects"), F.filter(x["at"], lambda p: p["kind"] == "excluded").alias("phrases"), x["host"].alias("host")),
    )
    hits = F.transform(F.transform(heard, lambda x: _hits(body, x["host"], x["subjects"], x["phrases"])), suppress_inner_names)
    settled = F.when(F.col("names").isNotNull(), F.get(hits, F.lit(0)))
    return joined.withColumn(out, F.coalesce(settled, F.array().cast(kind))).drop("_key", "names")

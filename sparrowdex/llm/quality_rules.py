"""Quality rules as a bitmask ledger: measure once, store failure bits, apply versioned policies. DataFrame functions only.

The ledger is a table in a folder: it is written once, and policies and ablations of any version read it alone, not the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table

GAPS = r"[\x20\x09-\x0D]+"
NGRAM = 8
LEDGER_VERSION = 1

#: Rules in the order of their bits: name, SQL that is true where the document fails. Integers only, so every engine agrees.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeats", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("dup_lines", "3 * n_dup_lines > 2 * n_lines"),
    ("long_words", "word_chars > 16 * n_words"),
    ("shouting", "2 * n_upper > word_chars"),
]
BASE = ("few_words", "repeats")
#: Versioned policies: the rules that a document must pass.
POLICIES = {1: ("few_words", "repeats"), 2: tuple(name for name, _ in RULES)}
CURRENT_POLICY = 2


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda variable is never computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAPS), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Number of words in NGRAM-word windows found twice or more in the text, first included.

    Most texts repeat no window: counting distinct window hashes shows it. Only others sort their windows.
    """
    starts = F.when(F.size(words) >= NGRAM, F.sequence(F.lit(1), F.size(words) - (NGRAM - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, NGRAM)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def pick(s: Column) -> Column:
            same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            twice = F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
            add = lambda a, i: F.struct((a["n"] + i + NGRAM - F.greatest(i, a["to"])).alias("n"), (i + NGRAM).alias("to"))
            return F.aggregate(twice, start, add, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered, pick))

    return _let(hashes, covered)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with every measurement that the rules use. Null text: no words. No shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, GAPS, "") != "")
    per_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")
    )
    per_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    d = docs.select(F.col(id_col), _let(words_of(text), per_words).alias("w"), _let(lines, per_lines).alias("l"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.length(F.regexp_replace(text, r"[^A-ZÀ-ÖØ-Þ]+", "")).cast("long").alias("n_upper"))
    return d.select(id_col, "w.*", "l.*", "n_symbols", "n_upper")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements, and `fail_bits`: bit k is set where RULES[k] fails. Each rule is evaluated once; policies read the bits alone."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(sql), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, sql) in enumerate(RULES)])
    return measured(docs, id_col, text_col).withColumn("fail_bits", bits).withColumn("ledger_version", F.lit(LEDGER_VERSION))


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Appends the ledger of `docs` to the table in `folder`, under LEDGER_VERSION."""
    ledger(docs, id_col, text_col).write.mode("append").partitionBy("ledger_version").parquet(folder)


def stored(spark: SparkSession, folder: str, version: int = LEDGER_VERSION) -> DataFrame:
    """The ledger of one version of the rules, as stored; of no rows if nothing was stored under that version."""
    return spark.read.parquet(folder).where(F.col("ledger_version") == version)


def mask_of(names) -> int:
    order = [name for name, _ in RULES]
    return sum(1 << order.index(n) for n in names)


def apply_policy(rows: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """The ledger with `kept`: none of the policy's bits is set."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0)


def ablations(rows: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that fail it alone (kept again without it), rows kept in all.

    One aggregation of the failure bits: rows are first counted by bit pattern, of which there are 2^rules at most.
    """
    mask = mask_of(POLICIES[version])
    by_bits = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    one = [F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES) if name in POLICIES[version]]
    each = by_bits.withColumn("r", F.explode(F.array(*one)))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("r.rule").agg(
        count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("fails"), count(F.col("bits") == F.col("r.bit")).alias("fails_alone"), count(F.col("bits") == 0).alias("kept")
    )


def gains(rows: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """(bits, n_gained) for each pattern of the policy's failure bits in `rows`: how many rows it would keep besides, if it dropped these rules.

    Rows are counted by pattern; each pattern's count goes to all patterns that hold its bits: 2^rules rows at most on either side.
    """
    mask = mask_of(POLICIES[version])
    by_bits = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    holding = F.filter(F.expr(f"sequence(0L, {mask}L)"), lambda x: F.col("bits").bitwiseAND(x) == F.col("bits"))
    held = by_bits.where("bits <> 0").select("n", F.explode(holding).alias("bits"))
    sums = held.groupBy("bits").agg(F.sum("n").alias("n_gained"))
    return by_bits.select("bits").join(F.broadcast(sums), "bits", "left").select("bits", F.coalesce("n_gained", F.lit(0)).cast("long").alias("n_gained"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents under the current policy, from a ledger that is stored first and read back for everything else.

    n_gained: documents that the policy would keep besides without the rules that this one fails. A null text has no words and fails few_words;
    null and repeated ids each get their own row; extra columns do not matter; an empty table gives no rows.
    """
    folder = new_folder(spark, "rule-ledger")
    store(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    rows = apply_policy(stored(spark, folder))
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[CURRENT_POLICY])).cast("long"))
    rows = rows.withColumn("bits", failed).join(F.broadcast(gains(rows)), "bits")  # 2^rules rows at most
    base = F.col("fail_bits").bitwiseAND(F.lit(mask_of(BASE)).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "n_upper", "fail_bits", "n_gained")


_FAILED = " + ".join(f"CASE WHEN {sql} THEN {1 << k} ELSE 0 END" for k, (_, sql) in enumerate(RULES))
ORACLE = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT rid, unnest(range(1, len(words) - {NGRAM} + 2)) AS i, words FROM w WHERE len(words) >= {NGRAM}),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i : i + {NGRAM - 1}]) AS n FROM g),
p AS (SELECT rid, i, least({NGRAM}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {NGRAM})) AS c FROM h WHERE n > 1),
r AS (SELECT rid, sum(c) AS c FROM p GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, coalesce(r.c, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, ({_FAILED})::BIGINT AS fail_bits FROM m),
b AS (SELECT fail_bits & {mask_of(POLICIES[CURRENT_POLICY])} AS bits, count(*) AS n FROM f GROUP BY 1),
a AS (SELECT x.bits, coalesce(sum(y.n), 0)::BIGINT AS n_gained FROM b x LEFT JOIN b y ON y.bits <> 0 AND y.bits & x.bits = y.bits GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask_of(BASE)}) <> 0 AS base_failed,
       (fail_bits & {mask_of(POLICIES[CURRENT_POLICY])}) = 0 AS kept, n_lines, n_upper, fail_bits, n_gained FROM f JOIN a ON a.bits = fail_bits & {mask_of(POLICIES[CURRENT_POLICY])}
"""

"""Quality rules by host: a host whose documents mostly fail a rule is rejected with all its documents.

Each document is measured once and judged by RULES. Failures are added up by host (the column source) and rule. A rate of few
documents says little, so each rule's rates are shrunk by a beta prior fitted to all hosts' counts by moments: a host's shrunk rate is
(failed + a) / (n + a + b). A host of which a rule's shrunk rate is REJECT or more is rejected; its verdict joins back to
its documents.

The measures (not the texts) are stored and aggregated on the map side, so a host with most of the rows is a few partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, text_batches

WINDOW, LEAST_WORDS, REJECT = 3, 50, 0.5
#: Up to this many rejected hosts are broadcast (their names and nothing else); more are joined by shuffle, salted.
BROADCAST_HOSTS, SALTS = 100_000, 64
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: A document fails a rule if the expression holds, in whole numbers.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "words": "word_chars < 2 * n_words or word_chars > 12 * n_words",
}
BASE = ("short", "repeats")
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))


def repeated_words(words: list[bytes]) -> int:
    """How many of the words are in a WINDOW of words that is found twice or more."""
    if len(words) < WINDOW + 1:
        return 0
    names: dict[bytes, int] = {}
    code = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    n, key = len(words) - WINDOW + 1, code[: len(words) - WINDOW + 1]
    for k in range(1, WINDOW):
        # Names of windows stay below the number of words, so that products fit 64 bits.
        _, key = np.unique(key * len(names) + code[k : k + n], return_inverse=True)
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= twice
    return int(covered.sum())


def measured(text: str | None) -> tuple[int, ...]:
    """The six MEASURES of a whole text; a null text is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at the six ASCII whitespace characters
    at = np.frombuffer(raw, np.uint8)
    chars = int(((at & 0xC0) != 0x80).sum() - _SPACES[at].sum())
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return len(words), chars, int(_SYMBOLS[at].sum()), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source and the MEASURES of each row of docs (doc_id, source, text); other columns are not read, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measured(t) for t in batch.column("text").to_pylist()], np.int64).reshape(batch.num_rows, 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *map(pa.array, found.T)], ["doc_id", "source", *(m.split()[0] for m in MEASURES.split(", "))])

    own = text_batches(docs.select("doc_id", "source", "text"))
    kinds = dict(own.dtypes)
    return own.mapInArrow(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, {MEASURES}")


def host_rates(measures: DataFrame) -> DataFrame:
    """One row per host and rule: source, rule, n, failed, a, b (the rule's prior) and rate, shrunk.

    The prior has the mean and the spread of the hosts' rates, each host counted once: with p the mean rate, v its variance and e the
    mean of p (1 - p) / n that chance alone gives, a + b = p (1 - p) / (v - e) - 1, at least 1, and 1000 where the rates vary no more than by chance.
    A null source is no host.
    """
    sums = measures.filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(rule).cast("long")).alias(name) for name, rule in RULES.items()))
    each = sums.select("source", "n", F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("failed")) for name in RULES))))
    p = F.col("failed") / F.col("n")
    prior = each.groupBy("rule").agg(F.avg(p).alias("p"), F.var_pop(p).alias("v"), F.avg(1 / F.col("n")).alias("share"))  # a row a rule
    chance = F.col("p") * (1 - F.col("p"))
    spread = F.col("v") - chance * F.col("share")
    weight = F.when((chance > 0) & (spread > chance / 1001), F.greatest(F.lit(1.0), chance / spread - 1)).otherwise(1000.0)
    prior = prior.select("rule", (F.col("p") * weight).alias("a"), ((1 - F.col("p")) * weight).alias("b"))
    return each.join(F.broadcast(prior), "rule").withColumn("rate", (F.col("failed") + F.col("a")) / (F.col("n") + F.col("a") + F.col("b")))


def _with_verdict(measures: DataFrame, rejected: DataFrame) -> DataFrame:
    """measures with host_rejected; only names of rejected hosts are joined."""
    if rejected.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        marked = F.broadcast(rejected.select(F.col("source").alias("host_"), F.lit(True).alias("host_rejected")))
        return measures.join(marked, F.col("source") == F.col("host_"), "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).drop("host_")
    salt = F.pmod(F.xxhash64("doc_id", *(m.split()[0] for m in MEASURES.split(", "))), F.lit(SALTS))
    each = rejected.select(F.col("source").alias("host_"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt_"), F.lit(True).alias("host_rejected"))
    found = measures.withColumn("salt", salt).join(each.hint("shuffle_hash"), (F.col("source") == F.col("host_")) & (F.col("salt") == F.col("salt_")), "left")
    return found.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).drop("host_", "salt_", "salt")


def failed_base() -> Column:
    return F.expr(" or ".join(f"({RULES[name]})" for name in BASE))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, source, text): doc_id, source, the MEASURES, base_failed, host_rejected and kept.

    kept is that the document itself passes BASE and its host is not rejected. A null text is empty, and fails; a null source is no host, so
    the document's own result holds. Equal texts have equal measures, repeated rows stay. A text of any length is measured whole, in its row.
    Columns besides the three are not read. An empty table gives an empty result.
    """
    measures = settle(measure(docs))
    rejected = settle(host_rates(measures).filter(F.col("rate") >= REJECT).select("source").distinct())
    found = _with_verdict(measures.withColumn("base_failed", failed_base()), rejected)
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


_WORD, _BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
ORACLE_SQL = f"""
with rows as materialized (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
cut as materialized (select r, doc_id, source, t, regexp_extract_all(t, '{_WORD}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from rows),
places as materialized (select r, unnest(w) as word, generate_subscripts(w, 1) as i from cut where len(w) > 0),
windows as (select r, i, word, lead(word, 1) over x as word2, lead(word, 2) over x as word3 from places window x as (partition by r order by i)),
found as (select r, i, count(*) over (partition by r, word, word2, word3) > 1 and word3 is not null as twice from windows),
covered as (select r, max(twice::int) over (partition by r order by i rows between 2 preceding and current row) as c from found),
repeats as (select r, sum(c)::bigint as n_repeat_words from covered group by r),
measures as materialized (select c.r, doc_id, source, len(w)::bigint as n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from cut c left join repeats using (r)),
judged as materialized (select *, {", ".join(f"({rule}) as {name}" for name, rule in RULES.items())} from measures),
each as materialized (select source, rule, count(*) as n, sum(failed::int) as failed from (unpivot (select source, {", ".join(RULES)} from judged where source is not null) on {", ".join(RULES)} into name rule value failed) group by source, rule),
moments as (select rule, avg(failed / n) as p, var_pop(failed / n) as v, avg(1 / n) as share from each group by rule),
weighed as (select rule, p, case when p * (1 - p) > 0 and v - p * (1 - p) * share > p * (1 - p) / 1001 then greatest(1.0, p * (1 - p) / (v - p * (1 - p) * share) - 1) else 1000.0 end as weight from moments),
hosts as (select distinct source from each join weighed using (rule) where (failed + p * weight) / (n + weight) >= {REJECT})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({" or ".join(BASE)}) as base_failed, source is not null and source in (select source from hosts) as host_rejected,
  not ({" or ".join(BASE)}) and not (source is not null and source in (select source from hosts)) as kept from judged
"""

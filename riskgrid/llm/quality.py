"""Quality rules (6): weak supervision.

Each rule votes keep (1), drop (-1) or abstains (0) on a text's features.  The vote patterns of
all documents are counted (at most 3**rules rows, whatever the corpus), and expectation-
maximisation over the counts estimates each rule's accuracies and the share of good texts.  A
document's posterior probability of being good replaces "all rules must pass".

Defined results: a null text has no words; texts without words have all features 0 and fail the
base rules; repeated rows are judged alike; an empty table gives no rows.  Only ``doc_id`` and
``text`` are read (``keep_good`` carries all columns along).  A text's arrays take about 40 times
its bytes in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskgrid.llm.common import SLIM_BYTES, documents, text_chunks, tidy, written
from riskgrid.llm.textkernel import Words, buffers, repeated

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_distinct", "n_letters", "n_upper", "n_exclaim", "n_bare_words", "n_odd_words"]
WINDOW = 5
#: EM: rounds, and the bounds of estimated probabilities.
ROUNDS, FLOOR = 200, 1e-4
POSTERIOR = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: A plain word: letters, digits, ' and -, with at most one of these marks before or after.
_PLAIN, _OPENS, _CLOSES = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39, 45]] = True
_OPENS[list(b'"([')] = True
_CLOSES[list(b'.,;:?!")]')] = True


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns ``FEATURES`` of a chunk of texts (no nulls)."""
    data, offsets = buffers(texts)
    n = len(texts)
    w = Words(data, offsets)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[offsets[1:]] - total[offsets[:-1]]

    starts_char = (data & 0xC0) != 0x80
    lower, upper = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90)
    out = {"n_words": w.count, "n_symbols": per_doc(_SYMBOL[data]), "n_letters": per_doc(lower | upper),
           "n_upper": per_doc(upper), "n_exclaim": per_doc(data == 33)}
    chars = np.concatenate(([0], np.cumsum(starts_char)))
    out["word_chars"] = np.bincount(w.doc, chars[w.end] - chars[w.start], n).astype(np.int64)
    alnum = np.concatenate(([0], np.cumsum(lower | upper | (data >= 128) | ((data >= 48) & (data <= 57)))))
    out["n_bare_words"] = np.bincount(w.doc, alnum[w.end] == alnum[w.start], n).astype(np.int64)

    odd = np.concatenate(([0], np.cumsum(~_PLAIN[data])))
    outer = _OPENS[data[w.start]].astype(np.int64) + _CLOSES[data[w.end - 1]]
    out["n_odd_words"] = np.bincount(w.doc, odd[w.end] - odd[w.start] > outer, n).astype(np.int64)

    # a hash per (text, value): equal values of different texts must not meet
    salt = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h, at = w.windows(WINDOW)
    cover = np.zeros(len(w.hash) + 1, np.int64)
    again = at[repeated(h ^ salt[w.doc[at]])] if len(at) else at
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(w.doc, np.cumsum(cover[:-1]) > 0, n).astype(np.int64)
    out["n_distinct"] = _distinct(w.hash ^ salt[w.doc], w.doc, n)

    # lines: cut at \n and at the ends of texts; those with a word count
    newline = np.flatnonzero(data == 10)
    doc = np.concatenate((np.arange(n), np.searchsorted(offsets, newline, side="right") - 1))
    begin, end = np.concatenate((offsets[:-1], newline + 1)), np.concatenate((offsets[1:], newline))
    begin, end = begin[np.lexsort((begin, doc))], end[np.lexsort((end, doc))]
    doc = np.sort(doc)
    has_word = np.searchsorted(w.start, begin) < np.searchsorted(w.start, end)
    begin, end, doc = begin[has_word], end[has_word], doc[has_word]
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(w.bytes.of(begin, end) ^ salt[doc], doc, n)
    return out


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(keys, return_index=True)
    return np.bincount(doc[first], minlength=n)


def measured(docs: DataFrame, carry: list[str], prefix: str = "") -> DataFrame:
    """The columns ``carry`` of ``docs`` plus ``FEATURES`` (long) of its ``text``."""
    schema = StructType([docs.schema[c] for c in carry] + [StructField(prefix + f, LongType()) for f in FEATURES])

    def run(batches):
        for batch in batches:
            for first, last in text_chunks(batch, limit=SLIM_BYTES):
                part = batch.slice(first, last - first)
                f = features(part.column("text").fill_null(""))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in carry] + [pa.array(f[c].astype(np.int64)) for c in FEATURES],
                    schema.names)

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(tidy(run), schema)


def rules(prefix: str = "") -> dict[str, Column]:
    """Name -> vote.  A ratio beyond the first bound drops, within the second keeps."""
    def c(name: str) -> Column:
        return F.col(prefix + name)

    def ratio(part: Column, whole: Column, drop_over: float, keep_within: float) -> Column:
        return (F.when(whole <= 0, 0).when(part > whole * drop_over, -1).when(part <= whole * keep_within, 1)
                .otherwise(0))

    return {
        "odd_words": ratio(c("n_odd_words"), c("n_words"), 0.4, 0.15),
        "symbols": ratio(c("n_symbols"), c("n_words"), 0.10, 0.03),
        "shouting": F.when(c("n_letters") < 20, 0).otherwise(ratio(c("n_upper"), c("n_letters"), 0.5, 0.2)),
        "exclaims": ratio(c("n_exclaim"), c("n_words"), 0.25, 0.05),
        "repeats": ratio(c("n_repeat_words"), c("n_words"), 0.20, 0.05),
        "few_distinct": F.when(c("n_words") < 50, 0).when(c("n_distinct") * 6 < c("n_words"), -1).otherwise(0),
        "dup_lines": F.when(c("n_lines") < 3, 0).otherwise(ratio(c("n_dup_lines"), c("n_lines"), 0.3, 0.0)),
        "bare_words": ratio(c("n_bare_words"), c("n_words"), 0.2, 0.05),
        "word_length": F.when(c("n_words") < 10, 0).when(c("word_chars") > c("n_words") * 14, -1)
        .when(c("word_chars") < c("n_words") * 2, -1).when(c("word_chars") <= c("n_words") * 10, 1).otherwise(0),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) with counts.  Gives the share of good texts and
    P(drop | good), P(drop | bad) by rule, among the texts that the rule votes on.  A rule drops
    bad texts more often than good ones: its estimates are kept in that order."""
    share, n_rules = 0.8, patterns.shape[1]
    drop = np.array([[0.1] * n_rules, [0.5] * n_rules])
    down, votes = patterns == -1, patterns != 0
    for _ in range(ROUNDS):
        good = posterior(patterns, share, drop)
        weight = np.stack([good, 1 - good]) * counts
        new = np.stack([(w[:, None] * down).sum(0) + 0.5 for w in weight]) / np.stack(
            [(w[:, None] * votes).sum(0) + 1.0 for w in weight])
        new = np.clip(new, FLOOR, 1 - FLOOR)
        mid = new.mean(0)
        new = np.stack([np.minimum(new[0], mid), np.maximum(new[1], mid)])
        new_share = float(np.clip(weight[0].sum() / max(1.0, counts.sum()), 0.5, 1 - FLOOR))
        moved = max(np.abs(new - drop).max(), abs(new_share - share))
        share, drop = new_share, new
        if moved < 1e-9:
            break
    return share, drop


def posterior(patterns: np.ndarray, share: float, drop: np.ndarray) -> np.ndarray:
    """P(good | votes)."""
    log = np.stack([np.log(s) + (patterns == -1) @ np.log(d) + (patterns == 1) @ np.log(1 - d)
                    for s, d in ((share, drop[0]), (1 - share, drop[1]))])
    return 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))


def fit(table: DataFrame) -> tuple[float, np.ndarray]:
    """The model from the vote patterns of a feature table."""
    pattern = F.array(*[v.cast("int") for v in rules().values()])
    counted = table.groupBy(pattern.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # <= 3**rules rows
    patterns = np.array([r.p for r in counted], np.int64).reshape(-1, len(rules()))
    return estimate(patterns, np.array([r.n for r in counted], float))


def verdicts(model: tuple[float, np.ndarray], prefix: str = "") -> tuple[Column, Column, Column]:
    """``base_failed, p_good, kept`` as expressions on the features."""
    share, drop = model
    # the log odds are a sum over the rules
    odds = F.lit(float(np.log(share / (1 - share))))
    for i, v in enumerate(rules(prefix).values()):
        odds = (odds + F.when(v == -1, float(np.log(drop[0][i] / drop[1][i])))
                .when(v == 1, float(np.log((1 - drop[0][i]) / (1 - drop[1][i])))).otherwise(0.0))
    n_words, n_repeat = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    base_failed = (n_words < 10) | (n_repeat * 100 > n_words * 20)
    p_good = 1 / (1 + F.exp(-odds))
    return base_failed, p_good, ~base_failed & (p_good >= POSTERIOR)


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``FEATURES``, ``base_failed``, ``p_good``, ``kept`` by document row."""
    # one pass over the texts; the slim features are read twice
    table = written(measured(docs, ["doc_id"]))
    base_failed, p_good, kept = verdicts(fit(table))
    return table.withColumns({"base_failed": base_failed, "p_good": p_good, "kept": kept})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns.  The model is fitted in one pass over the
    texts and applied in a second one, so that texts are neither shuffled nor written."""
    model = fit(measured(docs, []))
    _, _, kept = verdicts(model, "__quality_")
    return measured(docs, docs.columns, "__quality_").where(kept).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: features and verdict of every document."""
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")

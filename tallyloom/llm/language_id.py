"""Language identification of mixed-language text.

A word's script (by ranges of code points) narrows its candidate languages to those that use the script. Each word has a
score for each candidate: from word counts where the word was seen, else from its letter trigrams. Viterbi with a penalty
for switching then labels spans; a document's language is that of most of its words, and the score their share.

Training: about SAMPLE_ROWS labelled documents (a bounded sample by hash of doc_id; the bound is a parameter; the rarest
languages are taken whole, the others in equal parts), the VOCABULARY most frequent words that occur twice or more, and 65536
trigram buckets a language; whole texts. Prediction: every document, whole.

Viterbi is exact. A text whose best single language can't be beaten (by what another language gains over
any stretch of words) is settled at once (if the gain is at most half the
penalty: a path without the best language has one switch less than stretches); the others run through the recursion, many texts at a time.

Defined results: texts that are null or have no letter get `und` and score 0; without any labelled document all do; ties
go to the first language in code-point order; null ids are neither held out nor learned from; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textops
from .common import cut, documents

SAMPLE_ROWS, VOCABULARY, BUCKETS = 20_000, 200_000, 1 << 16
PENALTY, CLIP, FOREIGN = 6.0, 8.0, 12.0
#: A word: letters (category L) with the marks on them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: First code point of each range, and its script.
SCRIPTS = [(0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han")]
STARTS, NAMES = np.array([a for a, _ in SCRIPTS]), sorted({b for _, b in SCRIPTS})
OF = np.array([NAMES.index(b) for _, b in SCRIPTS])


def script(words: list[str]) -> np.ndarray:
    return OF[np.searchsorted(STARTS, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), "right") - 1]


def split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of each word, number of words of each text, the distinct words)."""
    every: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = LETTERS.findall(t.lower())
            counts[i] = len(w)
            every += w
    d = pa.array(every, pa.large_string()).dictionary_encode()
    return d.indices.to_numpy(), counts, d.dictionary.to_pylist()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each letter trigram of the words, edges marked; which word it is of)."""
    of, at, k = [], [], 0
    text = " ".join(words)
    cp = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    of = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(of)) + of  # one blank after each word
    k = (cp[at] * np.uint64(0x9E3779B1) ^ cp[at + 1] * np.uint64(0x85EBCA77) ^ cp[at + 2] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (k >> np.uint64(48)).astype(np.int64), of


def counter(batches):
    """Training texts -> word counts, trigram counts (kind 1) and letters by script (kind 2) of each language."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}

    def out(kind, lang, keys, n):
        return pa.record_batch([pa.array([kind] * len(n), pa.int32()), pa.array([lang] * len(n), pa.string()), pa.array(keys, pa.string()), pa.array(n, pa.int64())], ["kind", "lang", "key", "n"])

    for b in batches:
        langs = b["lang"].to_pylist()
        for lang in sorted(set(langs)):
            for texts in textops.chunks([t for t, x in zip(b["text"].to_pylist(), langs, strict=True) if x == lang]):
                codes, _, vocabulary = split(texts)
                if not len(codes):
                    continue
                n = np.bincount(codes, minlength=len(vocabulary))
                k, of = trigrams(vocabulary)
                grams[lang] = grams.get(lang, 0) + np.bincount(k, n[of], BUCKETS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(script(vocabulary), n, len(NAMES))
                yield out(0, lang, vocabulary, n)
    for lang in grams:
        k = np.flatnonzero(grams[lang])
        yield out(1, lang, list(map(str, k.tolist())), grams[lang][k].astype(np.int64))
        k = np.flatnonzero(scripts[lang])
        yield out(2, lang, [NAMES[i] for i in k.tolist()], scripts[lang][k].astype(np.int64))


class Model:
    """Word and trigram scores: logarithms of likelihoods, relative to the best language and clipped."""

    def __init__(self, langs: list[str], words: list[str], n: np.ndarray, totals: np.ndarray, grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.index = {w: i for i, w in enumerate(words)}
        self.words = self.relative(np.log((n + 0.1) / (totals + 0.1 * max(1, len(n))))).astype(np.float32)
        self.grams = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
        self.uses = scripts > 0.001 * np.maximum(1, scripts.sum(0))

    @staticmethod
    def relative(s: np.ndarray) -> np.ndarray:
        return np.maximum(s - s.max(1, keepdims=True), -CLIP) if s.size else s

    def scores(self, vocabulary: list[str]) -> np.ndarray:
        m = len(self.langs)
        at = np.fromiter((self.index.get(w, -1) for w in vocabulary), np.int64, len(vocabulary))
        out = np.zeros((len(vocabulary), m), np.float32)
        out[at >= 0] = self.words[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        if len(new):
            k, of = trigrams([vocabulary[i] for i in new.tolist()])
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            out[new] = self.relative(np.add.reduceat(self.grams[k], first))
        fits = self.uses[script(vocabulary)] if vocabulary else np.ones((0, m), bool)
        return out - FOREIGN * (~fits & fits.any(1, keepdims=True)).astype(np.float32)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word: sum of scores less the penalty for each switch. Rows are the texts' words in turn."""
    labels = np.zeros(len(scores), np.int64)
    starts = np.cumsum(counts) - counts
    some = np.flatnonzero(counts)
    if not len(some):
        return labels
    m = scores.shape[1]
    best = np.add.reduceat(scores.astype(np.float64), starts[some]).argmax(1)
    text = np.repeat(np.arange(len(some)), counts[some])
    labels[:] = best[text]
    mixed = np.zeros(len(some), bool)
    own = scores[np.arange(len(scores)), labels]
    for k in range(m):
        step = (scores[:, k] - own).astype(np.float64)
        gain = np.cumsum(step)
        gain -= (gain - step)[starts[some]][text]  # from each text's first word
        before = gain - step
        apart = text * (2 * np.abs(gain).max() + 1)  # each text starts lower than any before: running minima stay within it
        low = np.minimum.accumulate(before - apart) + apart
        mixed |= np.maximum.reduceat(gain - low, starts[some]) > penalty / 2 - 1e-3
    hard = some[mixed]
    if len(hard):
        hard = hard[np.argsort(-counts[hard], kind="stable")]
        n, at = counts[hard], starts[hard]
        alive = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # texts longer than t
        v = scores[at].astype(np.float64)
        back = np.zeros((len(scores), m), np.int8 if m < 128 else np.int16)
        last = np.zeros(len(hard), np.int64)
        for t in range(int(n[0])):
            a = int(alive[t])
            rows = at[:a] + t
            if t:
                top = v[:a].argmax(1)
                stay = v[:a] >= (v[np.arange(a), top] - penalty)[:, None]
                back[rows] = np.where(stay, np.arange(m), top[:, None])
                v[:a] = np.where(stay, v[:a], (v[np.arange(a), top] - penalty)[:, None]) + scores[rows]
            end = np.flatnonzero(n[:a] == t + 1)
            if len(end):
                last[end] = v[end].argmax(1)
        cur = last
        for t in range(int(n[0]) - 1, -1, -1):
            a = int(alive[t])
            rows = at[:a] + t
            labels[rows] = cur[:a]
            if t:
                cur[:a] = back[rows, cur[:a]]
    return labels


def labelled(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
    codes, counts, vocabulary = split(texts)
    if model is None or not len(codes):
        return [("und", 0.0, [])] * len(texts)
    labels = viterbi(model.scores(vocabulary)[codes], counts)
    out, at, m = [], 0, len(model.langs)
    for n in counts.tolist():
        mine = labels[at : at + n]
        at += n
        if not n:
            out.append(("und", 0.0, []))
            continue
        cuts = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), n]
        share = np.bincount(mine, minlength=m)
        top = int(share.argmax())
        out.append((model.langs[top], float(share[top] / n), [{"lang": model.langs[mine[a]], "first_word": a, "n_words": b - a} for a, b in zip(cuts, cuts[1:], strict=False)]))
    return out


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Model | None:
    d = docs.where(F.col("lang").isNotNull() & (remainder() != 2)).select("doc_id", "text", "lang")
    labels = {r.lang: r["count"] for r in d.groupBy("lang").count().collect()}  # a row for each language
    each, left = sample_rows, sample_rows
    for place, n in enumerate(sorted(labels.values())):  # the rarer languages whole, the others in equal parts
        each = left // (len(labels) - place)
        left -= min(n, each)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30))
    for lang, n in labels.items():
        if n > max(1, each):
            d = d.where((F.col("lang") != lang) | (drawn < int((1 << 30) * max(1, each) / n)))
    t = cut(d.select("text", "lang").mapInArrow(counter, "kind int, lang string, key string, n long").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")), "language-counts")
    scripts = t.where("kind = 2").collect()
    langs = sorted({r.lang for r in scripts})
    if not langs:
        return None
    no = {x: i for i, x in enumerate(langs)}
    s, g = np.zeros((len(NAMES), len(langs))), np.zeros((BUCKETS, len(langs)))
    for r in scripts:
        s[NAMES.index(r.key), no[r.lang]] = r.n
    k = t.where("kind = 1").select(F.col("key").cast("int").alias("k"), "lang", "n").toArrow()  # BUCKETS rows a language at most
    g[k["k"].to_numpy(), [no[x] for x in k["lang"].to_pylist()]] = k["n"].to_numpy()
    w = t.where("kind = 0").groupBy("key").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)], F.sum("n").alias("all"))
    w = w.where("all > 1").orderBy(F.desc("all"), "key").limit(vocabulary).drop("all").toArrow()
    words, counts = w["key"].to_pylist(), np.array([w[f"n{i}"].to_numpy() for i in range(len(langs))], float).reshape(len(langs), -1).T
    totals = {r.lang: r.n for r in t.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    return Model(langs, words, counts, np.array([totals[x] for x in langs], float), g, s)


SPANS = "array<struct<lang:string,first_word:int,n_words:int>>"


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns of keep, and lang_pred, score, spans (lang, first_word, n_words) of each text."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY and BUCKETS
    kinds = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))

    def run(batches):
        for b in batches:
            got = [x for texts in textops.chunks(b["text"].to_pylist(), 2 << 20) for x in labelled(known.value, texts)]
            yield pa.record_batch([*(b[c] for c in keep), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], kinds)], [*keep, "lang_pred", "score", "spans"])
        pa.default_memory_pool().release_unused()  # workers live on

    d = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = StructType([*d.select(*keep).schema, *StructType.fromDDL(f"lang_pred string, score double, spans {SPANS}")])
    return d.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs.select("doc_id", "text"), train(docs), ["doc_id"])
    return out.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those without any letter (null and empty texts too) go.

    Repeated rows all stay; an empty table gives an empty result; all columns of docs are returned, whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")  # no name of theirs can clash
    return identify(rows, train(docs), ["row"]).where("lang_pred != 'und'").select("row.*")

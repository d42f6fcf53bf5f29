"""Languages of documents and of the segments of mixed ones.

A character n-gram model is fitted on a bounded sample of labelled documents (``PER_LABEL`` of each language).
Labels may be wrong: the sample's sentences are reassigned to the language they are likeliest in and the model
is fitted again. Every document is then a mixture of languages: expectation-maximisation over its sentences
estimates the proportions from the n-gram likelihoods, and a language stays in its set only if leaving it out
costs more likelihood than ``PENALTY``. Segments are maximal runs of sentences of one language.

All sentences of a batch are scored together as arrays: n-grams are hashed into a table of log-probabilities
with a column for each language.
"""

from __future__ import annotations

import re
import sys
import types
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ["de", "en", "es", "fr", "it", "ja", "nl", "pl", "pt", "ru", "sv"]
PER_LABEL = 300  #: labelled documents of a language that the model is fitted on
SAMPLE_CHARS = (40, 6000)  #: only documents of so many characters are taken into the sample, whole
ROUNDS = 4  #: times the model is fitted
TABLE_BITS = 18
ORDERS = (1, 2, 3, 4)
BACKGROUND = 0.1  #: share of the pooled distribution in that of a language
PENALTY = 12.0  #: log-likelihood that a language must bring to a document
EM_ROUNDS = 12
MIN_LETTER_SHARE = 0.6  #: letters of words among the characters of a sentence that has words
BATCH_CHARS = 1 << 21

# A few frequent words of each language, so that a language without labelled documents is known at all.
FREQUENT_WORDS = {
    "de": "der die das und ist nicht ein eine mit auf den zu von wir",
    "en": "the and of to is not a in that with for it was on",
    "es": "el la los las y es no una con en que por para del",
    "fr": "le la les et est pas une avec dans que pour des du nous",
    "it": "il la gli e non una con che per di della sono nel è",
    "ja": "のは をに がと でし たこ れさ るな いも",
    "nl": "de het een en is niet met op van dat voor te zijn wij",
    "pl": "i w nie na się z to jest że do jak po przez który",
    "pt": "o a os as e é não uma com em que por para do",
    "ru": "и в не на что с он как это по но из за который",
    "sv": "och att det en som är inte på med av för den till vi",
}
# The codes and names under which these languages are labelled.
LABEL_NAMES = {
    "de": "deu ger german deutsch",
    "en": "eng english",
    "es": "spa spanish español castellano",
    "fr": "fra fre french français",
    "it": "ita italian italiano",
    "ja": "jpn japanese 日本語",
    "nl": "nld dut dutch nederlands",
    "pl": "pol polish polski",
    "pt": "por portuguese português",
    "ru": "rus russian русский",
    "sv": "swe swedish svenska",
}
LABELS = {name: code for code, names in LABEL_NAMES.items() for name in [code, *names.split()]}


def canonical_label(label: str | None) -> str | None:
    """The two-letter code a label stands for (codes, names and regional forms in any case); None if it is no language."""
    if label is None:
        return None
    text = label.strip().lower().replace("_", "-")
    return LABELS.get(text) or LABELS.get(text.split("-")[0])


# a sentence ends with a sign, up to two closing ones, and blanks, with a sign of full width, or with its line
_ENDS = re.compile(r"([.!?…][\"'”’»)\]]{0,2})\s+|([。！？][」』”]?)|\s*\n\s*")
_LETTERS = re.compile(r"[^\W\d_]+")
_ASCII_LETTERS = re.compile(r"[A-Za-z]+")
_DATA = re.compile(r"[\d_/\\²³¹¼-¾]")
_QUOTE = re.compile(r"[\"“„«「]|(?<![^\W\d_])'")
_QUOTED = re.compile(r"(?<![^\W\d_])'[^'\n]{2,80}'(?![^\W\d_])|\"[^\"\n]{2,80}\"|“[^”\n]{2,80}”|„[^“”\n]{2,80}[“”]|«[^»\n]{2,80}»|「[^」\n]{2,80}」")


def _tools():
    """The pattern of words that stand free of data, compiled once in each Python process; it needs the classes of the ``regex`` package."""
    store = sys.modules.setdefault("_framewright_worker", types.ModuleType("_framewright_worker"))
    if not hasattr(store, "free_words"):
        import regex

        store.free_words = regex.compile(r"(?<![\p{N}_/\\])\p{L}[\p{L}\p{M}'’]*(?![\p{N}_/\\])")
    return store.free_words


def sentences(text: str | None) -> list[str]:
    """The sentences and lines of a text, blank ones left out; a NUL ends a sentence too."""
    if not text:
        return []
    return [x for x in _ENDS.sub("\\1\\2\x00", text).split("\x00") if x and not x.isspace()]


def has_words(sentence: str) -> bool:
    """Whether a sentence consists of words rather than of data, code or signs."""
    if _DATA.search(sentence):
        words = [w for w in _tools().findall(sentence) if len(w) > 1 or w.isalpha()]
    else:
        words = (_ASCII_LETTERS if sentence.isascii() else _LETTERS).findall(sentence)
    return _are_words(words, sentence)


def _are_words(words: list[str], sentence: str) -> bool:
    letters = sum(map(len, words))
    if letters < 4 or letters < MIN_LETTER_SHARE * (len(sentence) - sentence.count(" ") - sentence.count("\t")):
        return False
    long = 0
    for w in words:
        if len(w) > 1:
            long += 1
            if long == 2:
                return True
    return letters >= 6 and any(w[0] > "⿿" for w in words)


def plain(sentence: str) -> str:
    """A sentence as the model sees it: quoted phrases left out unless they are nearly all of it, composed, lower
    case, letters only, single blanks."""
    if _QUOTE.search(sentence):
        bare = _QUOTED.sub(" ", sentence)
        if bare != sentence and has_words(bare):
            sentence = bare
    if sentence.isascii():
        return f" {' '.join(_ASCII_LETTERS.findall(sentence.lower()))} "
    return f" {' '.join(_LETTERS.findall(unicodedata.normalize('NFC', sentence).lower()))} "


def worded(sentence: str) -> str | None:
    """``plain`` of a sentence that consists of words, None of any other."""
    if sentence.isascii() and not _DATA.search(sentence) and not _QUOTE.search(sentence):
        words = _ASCII_LETTERS.findall(sentence)
        return f" {' '.join(words).lower()} " if _are_words(words, sentence) else None
    return plain(sentence) if has_words(sentence) else None


def _without_accents(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", text) if not unicodedata.combining(x))


def gram_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, starts): hashed n-grams of all texts one behind the other, those of text i from starts[i] on.

    Every character begins one n-gram of each order; n-grams that would run over a text's end fall on cell 0.
    """
    codes = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(x) + 1 for x in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    cells = np.zeros((len(codes), len(ORDERS)), np.int64)
    rolling, inside = np.zeros(len(codes), np.uint64), np.ones(len(codes), bool)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        inside &= shifted != 0
        rolling = rolling * np.uint64(1_000_003) + shifted
        if n in ORDERS:
            mixed = (rolling + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            cells[:, ORDERS.index(n)] = np.where(inside, 1 + (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int64) % ((1 << TABLE_BITS) - 1), 0)
    return cells, starts


def scores(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Log-likelihood of each plain text in each language, averaged over the orders; in portions, so memory is bounded."""
    out = np.zeros((len(texts), table.shape[1]))
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= BATCH_CHARS >> 2):
            size += len(texts[b])
            b += 1
        cells, starts = gram_cells(texts[a:b])
        total = table[cells[:, 0]]
        for k in range(1, len(ORDERS)):
            total += table[cells[:, k]]
        out[a:b] = np.add.reduceat(total, starts, axis=0) / len(ORDERS)
        a = b
    return out


def _table(texts: list[str], language: np.ndarray) -> np.ndarray:
    size = 1 << TABLE_BITS
    counts = np.zeros((len(LANGUAGES), size))
    for i in range(len(LANGUAGES)):
        own = [x for x, l in zip(texts, language) if l == i]
        if own:
            cells, _ = gram_cells(own)
            counts[i] = np.bincount(cells.ravel(), minlength=size)
    counts[:, 0] = 0
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    pooled = 0.99 * share.mean(axis=0) + 0.01 / size
    table = np.log((1 - BACKGROUND) * share + BACKGROUND * pooled)
    table[:, 0] = 0
    return np.ascontiguousarray(table.T.astype(np.float32))


def fit(labelled: list[tuple[str, str]], phrases: list[tuple[str, list[str]]] = ()) -> np.ndarray:
    """The table of log-probabilities from (language, text) pairs, and (language, plain texts) pairs of short
    phrases, whose labels may be wrong."""
    texts, first, doc = [], [], []
    for i, (lang, text) in enumerate(labelled):
        for s in sentences(text):
            if (words := worded(s)) is not None:
                texts.append(words)
                first.append(LANGUAGES.index(lang))
                doc.append(i)
    for i, (lang, short) in enumerate(phrases, len(labelled)):
        texts += short
        first += [LANGUAGES.index(lang)] * len(short)
        doc += [i] * len(short)
    seeds = [(f" {words} ", i) for i, words in enumerate(FREQUENT_WORDS[x] for x in LANGUAGES)]
    bare = [_without_accents(x) for x in texts]
    label = np.array(first, int)
    everything = [*texts, *bare, *[x for x, _ in seeds]]
    table = None
    for _ in range(ROUNDS):
        if table is not None and texts:
            label = _assigned(scores(texts, table), np.array(doc), len(labelled) + len(phrases))[0]
        table = _table(everything, np.concatenate([label, label, [i for _, i in seeds]]).astype(int))
    return table


def labelled_sample(documents: DataFrame, per_label: int = PER_LABEL) -> list[tuple[str, str]]:
    """Up to ``per_label`` (language, text) pairs for each language, by the hash of the text; a bounded sample for fitting."""
    code = F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.lower(F.trim(F.translate("lang", "_", "-"))))
    short = F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.split_part(F.lower(F.trim(F.translate("lang", "_", "-"))), F.lit("-"), F.lit(1)))
    sized = documents.where(F.length("text").between(*SAMPLE_CHARS)).select(F.coalesce(code, short).alias("code"), F.xxhash64("text").alias("h"), "text").where("code is not null")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("h"))
    return [(r["code"], r["text"]) for r in sized.withColumn("r", rank).where(F.col("r") <= per_label).select("code", "text").toLocalIterator()]


def fitted(documents: DataFrame) -> np.ndarray:
    """The model fitted on the labelled rows of ``documents``."""
    return fit(labelled_sample(documents))


def _mixtures(ll: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, likelihood) of each document by EM over its sentences within the allowed languages."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1]) if len(doc) else np.zeros(0, int)
    which = doc[edge] if len(doc) else np.zeros(0, int)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    top = ll.max(axis=1, keepdims=True)
    weight = np.exp(np.maximum(ll - top, -700))
    for _ in range(EM_ROUNDS):
        joint = weight * share[doc]
        total = np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        new = np.add.reduceat(joint / total, edge, axis=0) if len(doc) else np.zeros((0, ll.shape[1]))
        share[which] = new / new.sum(axis=1, keepdims=True)
    total = np.maximum((weight * share[doc]).sum(axis=1), 1e-300)
    likelihood = np.zeros(n_docs)
    np.add.at(likelihood, doc, np.log(total) + top[:, 0])
    return share, likelihood


def language_sets(ll: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(allowed, shares): each document's language set by penalised likelihood and its proportions.

    The set begins with the languages that are best for some sentence. Those whose loss would cost no more
    than PENALTY leave it, the cheapest first, one in each round.
    """
    allowed = np.zeros((n_docs, ll.shape[1]), bool)
    allowed[doc, ll.argmax(axis=1)] = True
    allowed[~allowed.any(axis=1), 0] = True
    share, base = _mixtures(ll, doc, n_docs, allowed)
    open_docs = np.flatnonzero(allowed.sum(axis=1) > 1)
    while len(open_docs):
        renumber = np.full(n_docs, -1)
        renumber[open_docs] = np.arange(len(open_docs))
        own = renumber[doc] >= 0
        part, part_doc = ll[own], renumber[doc[own]]
        loss = np.full((len(open_docs), ll.shape[1]), np.inf)
        for k in range(ll.shape[1]):
            has = allowed[open_docs, k]
            if has.any():
                without = allowed[open_docs].copy()
                without[has, k] = False
                loss[has, k] = (base[open_docs] - _mixtures(part, part_doc, len(open_docs), without)[1])[has]
        cheapest = loss.argmin(axis=1)
        drop = loss[np.arange(len(open_docs)), cheapest] <= PENALTY
        allowed[open_docs[drop], cheapest[drop]] = False
        new_share, new_base = _mixtures(part, part_doc, len(open_docs), allowed[open_docs])
        share[open_docs], base[open_docs] = new_share, new_base
        open_docs = open_docs[drop]
        open_docs = open_docs[allowed[open_docs].sum(axis=1) > 1]
    return allowed, share


def _assigned(ll: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(language of each sentence within its document's set, shares of the languages in each document)."""
    allowed, share = language_sets(ll, doc, n_docs)
    within = np.where(allowed[doc], ll + np.log(np.maximum(share[doc], 1e-9)), -np.inf)
    return within.argmax(axis=1), share


def _confidence(ll: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Posterior of each row's language ``best``, all languages being equally likely before.

    The orders' likelihoods are averaged, not added, so that n-grams that contain one another do not count as
    independent evidence; the posteriors are calibrated so (see the reliability test).
    """
    x = np.exp(ll - ll.max(axis=1, keepdims=True))
    return x[np.arange(len(ll)), best] / x.sum(axis=1)


def segment_texts(texts: list[str | None], table: np.ndarray) -> list[list[tuple[str, float, int, int]]]:
    """For each text its segments: (language, confidence, sentences, characters); none if it has no words."""
    known: dict[str, int] = {}  # sentence -> place of its plain text, -1 if it has no words; repeated ones are read once
    plains: list[str] = []
    which, sizes, doc = [], [], []
    for i, text in enumerate(texts):
        for s in sentences(text):
            k = known.get(s)
            if k is None:
                words = worded(s)
                k = known[s] = -1 if words is None else len(plains)
                if words is not None:
                    plains.append(words)
            if k >= 0:
                which.append(k)
                sizes.append(len(s))
                doc.append(i)
    out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
    if not plains:
        return out
    doc_no, size = np.array(doc), np.array(sizes)
    ll = scores(plains, table)[which]
    best, _ = _assigned(ll, doc_no, len(texts))
    first = np.flatnonzero(np.concatenate([[True], (doc_no[1:] != doc_no[:-1]) | (best[1:] != best[:-1])]))
    sure = _confidence(np.add.reduceat(ll, first, axis=0), best[first])
    chars, count = np.add.reduceat(size, first), np.diff(np.concatenate([first, [len(best)]]))
    for k, a in enumerate(first):
        out[doc_no[a]].append((LANGUAGES[best[a]], float(sure[k]), int(count[k]), int(chars[k])))
    return out


_SEGMENTS = "doc_id long, label string, seg_no int, lang string, confidence double, sentences int, chars long, segments int"


def language_segments(documents: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """(doc_id, label, seg_no, lang, confidence, sentences, chars, segments) of every document with words.

    ``label`` is the canonical form of the given label, null if it names no language. Null, empty and wordless
    texts have no segments, nor have rows without id; rows that repeat an id are each read, and give equal
    rows; other columns are ignored. Very long texts are read whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fitted(documents) if table is None else table)

    def segment(batches):
        for batch in batches:
            texts, a = batch["text"].tolist(), 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= BATCH_CHARS):
                    size += len(texts[b])
                    b += 1
                rows = []
                for doc_id, label, found in zip(batch["doc_id"][a:b], batch["lang"][a:b], segment_texts(texts[a:b], shared.value)):
                    code = canonical_label(label)
                    rows += [(doc_id, code, i, lang, sure, n, chars, len(found)) for i, (lang, sure, n, chars) in enumerate(found)]
                frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _SEGMENTS.split(", ")])
                yield frame.astype({"doc_id": "int64", "seg_no": "int32", "sentences": "int32", "chars": "int64", "segments": "int32"})
                a = b

    return documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInPandas(segment, _SEGMENTS)


def mislabelled_segments(documents: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang): all segments of documents whose label is missing or wrong, or that mix languages."""
    found = language_segments(documents)
    return found.where("label is null or segments > 1 or label <> lang").select("doc_id", "seg_no", "lang").distinct()


def document_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, label, lang, confidence, share, languages): each document's main language, by characters (of equal
    ones the first by code), the share of its text in it and how many languages it has."""
    each = language_segments(documents).select("doc_id", "label", "seg_no", "lang", "confidence", "chars").distinct()
    by_lang = each.groupBy("doc_id", "label", "lang").agg(F.sum("chars").alias("chars"), (F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars")).alias("confidence"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("chars")).alias("order"), "lang", "confidence")))  # one entry a language
    picked = by_lang.groupBy("doc_id", "label").agg(F.get(ranked, 0).alias("m"), F.sum("chars").alias("all"), F.count("*").cast("int").alias("languages"))
    return picked.select("doc_id", "label", "m.lang", "m.confidence", (-F.col("m.order") / F.col("all")).alias("share"), "languages")

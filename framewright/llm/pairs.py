"""Defects of the answers in prompt and response pairs.

Each answer is read from one of three body shapes and gets at most one defect: ``empty``, ``copied``,
``refusal``, ``truncated`` or ``other_language``, tried in this order. Copies, terminations and languages are
checked for each answer by itself; what stands in a field for refusals is one.

Other refusals are found over the whole corpus, by recurrence and without any list of wordings. The sentences of
the openings of prose answers are collapsed to distinct normalised ones and clustered by MinHash over word
shingles (five words, similarity 0.8, candidates verified, pairs it leaves out added exactly); the clusters are
templates. A short answer given whole, template for template, to several unrelated prompts answers none of them:
where that happens more often than its templates would meet by chance, they are *revealed*, unless most of their
answers say other things too. A sentence is one of *substance* if most of its word pairs also stand in other
sentences of answers without any revealed template. A template declines if at least half of its answers say
nothing of substance and those belong to several unrelated prompts; an answer with such a template and no sentence
of substance is a refusal. So a doubt within a real answer is none, and neither is one said under a single prompt.
Prompts are unrelated if their requests, without the lines of their tables, are in different clusters.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import langid
from framewright.operators.drift import read_json
from framewright.operators.graph import components
from framewright.session import cut

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4  #: of the MinHash rounds, which need not be complete: ``_missed_pairs`` adds every pair they leave out
OPENING = 3  #: sentences of an answer's opening
SHORT = 4  #: sentences of the longest answer that may recur as a whole
MIN_PROMPTS = 2  #: unrelated prompts that a template must recur for
CHANCE = 1e-3  #: probability by chance below which recurring as a whole reveals
COVERED = 0.6  #: share of a sentence's word pairs, known from other sentences of answers without a revealed template, that makes it one of substance
HALF = 0.5  #: share of a template's answers without substance from which it declines
FRAGMENT_WORDS = 5  #: words of the shortest last line that is taken as cut without a sign of it
LIMIT_REASONS = ("length", "max_tokens", "model_length", "max_output_tokens")  #: finish reasons of an answer that ran into its limit
SAMPLE_ANSWERS = 3000  #: responses, by the hash of their id, whose answers help to fit the language model
LANGUAGE_MARGIN = 3.0  #: log-likelihood by which another language must lead
TERMINAL = ".!?…。！？।"
CLOSING = "\"'”’»)]}」』*_`"

# Stems of language names as prompts write them.
NAMED_LANGUAGES = {
    "de": "german deutsch alemán alemão allemand tedesco duits tysk niemieck немецк ドイツ語",
    "en": "english englisch inglés inglês anglais inglese engels engelsk angielsk английск 英語",
    "es": "spanish spanisch español espanhol espagnol spagnolo spaans spansk hiszpańsk испанск スペイン語",
    "fr": "french französisch francés francês français francese frans fransk francusk французск フランス語",
    "it": "italian italienisch italiano italien italiaans italiensk włosk итальянск イタリア語",
    "ja": "japanese japanisch japonés japonês japonais giapponese japans japansk japońsk японск 日本語",
    "nl": "dutch niederländisch neerlandés holandés holandês néerlandais olandese nederlands nederländsk niderlandzk нидерландск オランダ語",
    "pl": "polish polnisch polaco polonês polonais polacco pools polsk польск ポーランド語",
    "pt": "portuguese portugiesisch portugués português portugais portoghese portugees portugisisk portugalsk португальск ポルトガル語",
    "ru": "russian russisch ruso russo russe russisch rysk rosyjsk русск ロシア語",
    "sv": "swedish schwedisch sueco suédois svedese zweeds svensk szwedzk шведск スウェーデン語",
}

_FENCE = re.compile(r"^\s*```[\w+-]*[ \t]*\n?|\n?\s*```\s*$")
_QUOTES = re.compile(r"[\s\"'`´“”„‘’‚«»‹›「」『』]+")
_ENTRY = re.compile(r"\s*(?:[-*•#]|\d+[.)])\s")
_CLOSED = re.compile(r"[.!?…][\"'”’»)\]}]*\s|[。！？]")
_LABELLED = re.compile(r"\S\s+[-–—]\s+\S|\S:\s+\S")
_TABLE_LINE = re.compile(r"(?m)^\s*\w{1,4}\s*,\s*\w+\s*$|^\s*id\s*,.*$")


def _invisible(ch: str) -> bool:
    return ch.isspace() or unicodedata.category(ch) in ("Cf", "Cc", "Zs", "Zl", "Zp", "Mn")


def is_blank(text: str) -> bool:
    """Nothing but blanks, invisible characters or an empty code fence."""
    return all(map(_invisible, re.sub(r"```[\w+-]*", "", text)))


def _text_of(content: object) -> str:
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "".join(x["text"] for x in content if isinstance(x, dict) and isinstance(x.get("text"), str) and x.get("type", "text") == "text")
    return ""


def answers(body: object) -> list[tuple[int, str, bool, str, str]]:
    """(choice index, text, has a tool call, text of a refusal field, finish reason) of each answer in a body.

    A missing or unusable ``index`` is read as the choice's place. A bare list is one answer, its own JSON text.
    """
    if isinstance(body, list):
        return [(0, json.dumps(body, ensure_ascii=False), False, "", "")]
    if not isinstance(body, dict):
        return []
    if isinstance(body.get("choices"), list):
        out = []
        for i, choice in enumerate(body["choices"]):
            if not isinstance(choice, dict):
                continue
            message = choice.get("message") if isinstance(choice.get("message"), dict) else {}
            index = choice.get("index")
            called = bool(message.get("tool_calls")) or bool(message.get("function_call"))
            refusal = message.get("refusal") if isinstance(message.get("refusal"), str) else ""
            out.append((index if isinstance(index, int) else i, _text_of(message.get("content")), called, refusal, str(choice.get("finish_reason") or "")))
        return out
    if "content" in body:
        content = body["content"]
        called = isinstance(content, list) and any(isinstance(x, dict) and x.get("type") == "tool_use" for x in content)
        refusal = body.get("refusal") if isinstance(body.get("refusal"), str) else ""
        return [(0, _text_of(content), called, refusal, str(body.get("stop_reason") or ""))]
    return []


def _bare(text: str) -> str:
    return _QUOTES.sub("", text if text.isascii() else unicodedata.normalize("NFC", text)).casefold()


def is_copy(text: str, prompt: str) -> bool:
    """Whether a text is nothing but text of its prompt, as a whole or line by line; case, spacing and quotes aside."""
    whole = _bare(prompt)
    if _bare(text.lstrip().partition("\n")[0][:40]) not in whole:
        return False  # then neither the text nor its first line is in the prompt
    own = _bare(text)
    if sum(map(str.isalnum, own)) < 3:
        return False
    return own in whole or all(_bare(line) in whole for line in text.splitlines())


def json_part(text: str) -> tuple[str, object]:
    """('json', value), ('cut', None) for JSON that does not end, or ('prose', None)."""
    inner = _FENCE.sub("", text).strip()
    at = min((i for i in (inner.find("["), inner.find("{")) if i >= 0), default=-1)
    if at < 0 or (at > 0 and not inner[:at].rstrip().endswith(":")):
        return ("cut", None) if re.match(r"\s*```", text) and text.count("```") == 1 and not is_blank(text) else ("prose", None)
    try:
        return "json", json.JSONDecoder().raw_decode(inner[at:])[0]
    except (ValueError, RecursionError):
        return "cut", None


def ends_within(text: str, reason: str = "") -> bool:
    """Whether prose stops inside a word or a sentence.

    Text that ends with a closing sign does not. Without one it is judged by its own habit and its finish reason:
    it stops inside if the reason is a limit, or if an earlier sentence of it is closed. Text without any closed
    sentence and without such a reason stops inside only if its last line is a phrase of FRAGMENT_WORDS words or
    more, and no list entry, heading, or entry with a dash or colon in the middle.
    """
    end = text.rstrip()
    while end and (_invisible(end[-1]) or end[-1] in CLOSING):
        end = end[:-1]
    if end and end[-1] in TERMINAL:
        return False
    if not end or reason.lower() in LIMIT_REASONS:
        return True
    last = end.rpartition("\n")[2]
    if _ENTRY.match(last):
        return False
    if _CLOSED.search(end):
        return True
    return end[-1] in ":,;(-" or (len(last.split()) >= FRAGMENT_WORDS and not _LABELLED.search(last))


def _strings(value: object, keys: tuple[str, ...] | None, out: list[str]) -> list[str]:
    todo = [(value, False)]
    while todo:
        v, wanted = todo.pop()
        if isinstance(v, dict):
            todo += [(x, keys is None or k.lower() in keys) for k, x in reversed(list(v.items()))]
        elif isinstance(v, list):
            todo += [(x, wanted) for x in reversed(v)]
        elif isinstance(v, str) and wanted:
            out.append(v)
    return out


def reasons(value: object) -> list[str]:
    """The texts under keys for reasons in a JSON answer."""
    return _strings(value, ("reason", "reasons", "reasoning", "explanation"), [])


def only_message(value: object) -> str:
    """The text of a JSON answer that is nothing but a message, as {"error": "..."}; else ''."""
    if isinstance(value, list) and len(value) == 1:
        value = value[0]
    if isinstance(value, dict) and value and all(isinstance(x, str) for x in value.values()) and {k.lower() for k in value} <= {"error", "message", "detail", "refusal"}:
        return " ".join(value.values())
    return ""


_NAMED = re.compile("|".join(f"(?P<{code}>" + "|".join((r"\b" if x[0].isalpha() and x[0] < "\u2fff" else "") + re.escape(x) for x in stems.split()) + ")" for code, stems in NAMED_LANGUAGES.items()))


def asked_language(request: str) -> str | None:
    """The language a prompt, its table lines left out, names for its answer, in its last line that names one."""
    for line in reversed(request.lower().splitlines()):
        named = {m.lastgroup for m in _NAMED.finditer(line)}
        if len(named) == 1:
            return named.pop()
    return None


def normalise(sentence: str) -> str:
    """A sentence as templates see it: lower case, digits as 0, single letters as x, signs dropped."""
    low = re.sub(r"\d+", "0", (sentence if sentence.isascii() else unicodedata.normalize("NFC", sentence)).lower())
    return " ".join("x" if len(w) == 1 and w.isalpha() and w.isascii() and w not in "ai" else w for w in re.findall(r"[\w'’]+", low))


def _language_text(kind: str, value: object, text: str) -> str:
    """What of an answer tells its language, as the model sees it: the reasons of JSON, or the prose; else ''."""
    words = "\n".join(reasons(value)) if kind == "json" else text
    return langid.plain(words) if any(map(str.isalpha, words)) else ""


def request_of(prompt: str) -> str:
    """A prompt without the lines of its table."""
    return _TABLE_LINE.sub("", prompt)


def expected_languages(requests: list[str], table: np.ndarray) -> list[str | None]:
    """The language each request wants: the one it names or else its own; None if neither can be told. Requests
    that are repeated are read once."""
    known: dict[str, str | None] = {}
    texts, owner = [], []
    for r in requests:
        if r not in known:
            known[r] = asked_language(r)
            if known[r] is None and (own := [langid.plain(s) for s in langid.sentences(r) if langid.has_words(s)]):
                texts.append("".join(own))
                owner.append(r)
    if texts:
        for r, k in zip(owner, langid.scores(texts, table).argmax(axis=1)):
            known[r] = langid.LANGUAGES[k]
    return [known[r] for r in requests]


def fit_languages(responses: DataFrame, documents: DataFrame) -> np.ndarray:
    """The language model: labelled documents, and the answers of SAMPLE_ANSWERS responses taken as labelled by
    what their prompts want (wrong ones are reassigned as wrong labels are)."""
    labelled = langid.labelled_sample(documents)
    table = langid.fit(labelled)
    sample = responses.where("prompt is not null and body is not null").select("response_id", "prompt", "body").orderBy(F.xxhash64("response_id"), "response_id").limit(SAMPLE_ANSWERS).toLocalIterator()
    rows = [(r["prompt"], x) for r in sample for x in answers(read_json(r["body"]))]
    phrases = []
    for (prompt, (_, text, *_rest)), lang in zip(rows, expected_languages([request_of(p) for p, _ in rows], table)):
        kind, value = json_part(text)
        if lang and not only_message(value) and not is_copy(text, prompt) and (words := _language_text(kind, value, text)):
            phrases.append((lang, [words]))
    return langid.fit(labelled, phrases)


_ANSWERS = "response_id long, choice_index long, prompt_key long, request string, defect string, later string, sentences array<struct<text:string,key:long,field:boolean,open:boolean>>"


def judge_answers(responses: DataFrame, table: np.ndarray) -> DataFrame:
    """One row per answer: its defect as far as the answer alone tells (``defect`` before a refusal found by
    recurrence, ``later`` after one), and the normalised sentences of prose answers for the search for those.

    ``request`` is the normalised prompt without its table, given once for each batch; ``prompt_key`` is its hash.
    """
    shared = responses.sparkSession.sparkContext.broadcast(table)

    def judge(batches):
        for batch in batches:
            rows, check, known = [], [], {}
            prompts = [p if isinstance(p, str) else "" for p in batch["prompt"]]
            requests = [request_of(p) for p in prompts]
            norms = {r: normalise(r) for r in set(requests)}
            keys = {r: hash_text(norm) for r, norm in norms.items()}
            wanted = expected_languages(requests, shared.value)
            for response_id, prompt, request, want, body in zip(batch["response_id"], prompts, requests, wanted, batch["body"]):
                for index, text, called, refusal, reason in answers(read_json(body)):
                    row = [response_id, index, keys[request], None, None, None, []]
                    rows.append(row)
                    if not is_blank(refusal):
                        row[4], row[6] = "refusal", _opening(refusal, True, known)
                        continue
                    if is_blank(text):
                        row[4] = None if called else "empty"
                        continue
                    if is_copy(text, prompt):
                        row[4] = "copied"
                        continue
                    kind, value = json_part(text)
                    message = only_message(value) if kind == "json" else ""
                    if message or kind == "prose":
                        row[6] = _opening(message or text, False, known)
                        row[3] = norms.pop(request, None)
                    if kind == "cut" or (kind == "prose" and ends_within(text, reason)):
                        row[5] = "truncated"
                        continue
                    if want and (words := _language_text(kind, value, message or text)):
                        check.append((row, langid.LANGUAGES.index(want), words))
            if check:
                ll = langid.scores([x for _, _, x in check], shared.value)
                best = ll.max(axis=1)
                for (row, want, _), top, own in zip(check, best, ll):
                    if top - own[want] > LANGUAGE_MARGIN:
                        row[5] = "other_language"
            yield pd.DataFrame(rows, columns=["response_id", "choice_index", "prompt_key", "request", "defect", "later", "sentences"]).astype({"response_id": "int64", "choice_index": "int64", "prompt_key": "int64"})

    return responses.mapInPandas(judge, _ANSWERS)


def hash_text(text: str) -> int:
    """64 bits of a text; among 10^10 distinct texts about three pairs are expected to share them."""
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _opening(text: str, field: bool, known: dict) -> list[dict]:
    """The sentences of a prose answer; ``known`` remembers the hashes of normalised sentences."""
    out = []
    for i, s in enumerate(x for x in langid.sentences(text) if any(map(str.isalnum, x))):
        norm = normalise(s)
        if norm:
            if norm not in known:
                known[norm] = hash_text(norm)
            out.append({"text": norm, "key": known[norm], "field": field, "open": i < OPENING})
    return out


def _signatures(batches):
    rng = np.random.default_rng(20240131)
    a = rng.integers(1, 1 << 61, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 61, BANDS * ROWS, dtype=np.uint64)
    for batch in batches:
        out = []
        for key, text in zip(batch["key"], batch["text"]):
            words = text.split()
            grams = {" ".join(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))}
            shingles = np.array(sorted(hash_text(g) for g in grams), np.int64)
            mixed = (shingles.astype(np.uint64)[:, None] * a + b) >> np.uint64(3)
            least = mixed.min(axis=0).reshape(BANDS, ROWS)
            marks = np.bitwise_xor.reduce(np.uint64(1) << (shingles.astype(np.uint64) & np.uint64(63))).astype(np.int64)
            out.append((key, shingles.tolist(), [hash_text(f"{i}:{row.tolist()}") for i, row in enumerate(least)], marks))
        yield pd.DataFrame(out, columns=["key", "shingles", "bands", "marks"]).astype({"key": "int64", "marks": "int64"})


def _missed_pairs(signed: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): every pair of sentences in different components that can have a similarity of SIMILARITY.

    Two such sentences share one of the rarest shingles of each, of which as many are taken as a sentence can lack
    and one more (a prefix filter), their numbers of shingles are in that proportion, and their marks, the parities
    of 64 classes of shingles, differ in no more places than the shingles that one of them lacks. None of these
    filters loses a pair. Components meet before their members do, so near copies that are joined already are not
    paired again.
    """
    said = signed.select("key", F.explode("shingles").alias("shingle"))
    ranked = said.join(said.groupBy("shingle").agg(F.count("*").alias("n")), "shingle").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("rarest"))
    size = F.size("rarest")
    rare = ranked.select("key", size.alias("size"), F.explode(F.slice("rarest", 1, size - F.ceil(size * SIMILARITY - 1e-9).cast("int") + 1)).alias("s")).where("s.n > 1")
    held = cut(rare.join(roots, "key").join(signed.select("key", "marks"), "key").select("s.shingle", "root", "size", "key", "marks"))
    group = held.select("shingle", "root", "size").distinct()
    left = group.withColumnsRenamed({"root": "ra", "size": "na"})
    right = group.withColumnsRenamed({"root": "rb", "size": "nb"})
    met = left.join(right, "shingle").where((F.col("ra") < F.col("rb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * SIMILARITY - 1e-9))
    member = lambda s: held.select("shingle", F.col("root").alias(f"r{s}"), F.col("size").alias(f"n{s}"), F.col("key").alias(s), F.col("marks").alias(f"m{s}"))
    differ = (F.col("na") + F.col("nb")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9
    both = met.join(member("a"), ["shingle", "ra", "na"]).join(member("b"), ["shingle", "rb", "nb"])
    return both.where(F.bit_count(F.col("ma").bitwiseXOR(F.col("mb"))) <= differ).select("a", "b").distinct()


def template_clusters(sentences: DataFrame) -> DataFrame:
    """(key, template): the cluster of each distinct sentence of (key, text), named by its smallest key.

    In a band's bucket each sentence is first held against the smallest one and against the next one by key, so a
    bucket of any size costs as much as it has members. That joins near copies; what a bucket that mixes templates
    leaves apart is then found among the components by ``_missed_pairs``, so every pair of similarity SIMILARITY
    is joined.
    """
    signed = cut(sentences.mapInPandas(_signatures, "key long, shingles array<long>, bands array<long>, marks long"))
    bucket = signed.select("key", F.explode("bands").alias("band"))
    w = Window.partitionBy("band").orderBy("key")
    near = bucket.select("key", F.first("key").over(w).alias("least"), F.lag("key").over(w).alias("prior"))
    pairs = near.select(F.col("key").alias("a"), F.explode(F.array("least", "prior")).alias("b")).where("b is not null and a <> b").distinct()
    side = lambda s: signed.select(F.col("key").alias(s), F.col("shingles").alias(f"s{s}"))
    shared = F.size(F.array_intersect("sa", "sb"))
    similar = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").where(shared / (F.size("sa") + F.size("sb") - shared) >= SIMILARITY).select("a", "b")
    whole = F.lit(0).alias("video_id")
    roots = components(similar(pairs).select(whole, "a", "b"), signed.select(whole, F.col("key").alias("node"))).select(F.col("node").alias("key"), "root")
    roots = cut(roots)
    missed = similar(_missed_pairs(signed, roots))
    of = lambda s: roots.select(F.col("key").alias(s), F.col("root").alias(f"r{s}"))
    links = missed.join(of("a"), "a").join(of("b"), "b").select(whole, F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    merged = components(links, roots.select(whole, F.col("root").alias("node")).distinct())
    return roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("template")), "root").select("key", "template")


_ANSWER = ["response_id", "choice_index"]


def opening_templates(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, prompts): (key, text, field, template, n) of each distinct sentence of prose answers, with whether it
    stands in a field for refusals and how often it is said; and (prompt_key, prompt), the cluster of each request."""
    said = judged.select(F.explode("sentences").alias("s")).select("s.*")
    distinct = cut(said.groupBy("key").agg(F.min("text").alias("text"), F.max("field").alias("field"), F.max("open").alias("open"), F.count("*").alias("n")))
    requests = judged.where("request is not null").groupBy(F.col("prompt_key").alias("key")).agg(F.min("request").alias("text"))
    clusters = cut(template_clusters(distinct.where("open").select("key", "text").unionByName(requests).groupBy("key").agg(F.min("text").alias("text"))))
    facts = distinct.join(clusters, "key", "left").select("key", "text", "field", F.coalesce("template", "key").alias("template"), "n")
    return facts, requests.select("key").join(clusters, "key").select(F.col("key").alias("prompt_key"), F.col("template").alias("prompt"))


def revealed_templates(said: DataFrame, facts: DataFrame, prompts: DataFrame) -> DataFrame:
    """(template): those of short answers that recur whole for unrelated prompts more often than by chance, and of
    sentences in fields for refusals, if at least half of the answers they stand in consist of such templates.

    By chance, an answer of k sentences is k templates drawn by how often each is said. That as many prompts as
    were seen get the same one has at most the probability exp(n - e - n ln(n / e)), e being the expected number.
    """
    template = facts.groupBy("template").agg(F.sum("n").alias("n"), F.max("field").alias("field"))
    held = said.where(F.col("size") <= SHORT).join(facts.select("key", "template"), "key").join(prompts, "prompt_key", "left")
    whole = held.groupBy(*_ANSWER, "size").agg(F.array_sort(F.collect_list(F.struct("place", "template"))).alias("lead"), F.min("prompt").alias("prompt")).select("size", F.col("lead.template").alias("lead"), "prompt")
    whole = cut(whole.groupBy("size", "lead", "prompt").agg(F.count("*").alias("n")))
    total = facts.agg(F.sum("n")).first()[0] or 1
    lengths = whole.groupBy("size").agg(F.sum("n").alias("answers"))  # SHORT rows
    again = whole.groupBy("size", "lead").agg(F.count("prompt").alias("seen")).where(F.col("seen") >= MIN_PROMPTS).withColumn("no", F.xxhash64("size", "lead"))
    parts = again.select("no", "size", "seen", F.explode("lead").alias("template")).join(template, "template")
    odds = parts.groupBy("no", "size", "seen").agg(F.sum(F.log(F.col("n") / total)).alias("odds"), F.collect_set("template").alias("templates")).join(F.broadcast(lengths), "size")
    e = F.col("answers") * F.exp("odds")
    beyond = odds.where((F.col("seen") > e) & (F.col("seen") * F.log(F.col("seen") / e) - F.col("seen") + e >= -float(np.log(CHANCE))))
    first = cut(beyond.select(F.explode("templates").alias("template")).unionByName(template.where("field").select("template")).distinct())
    hits = said.join(facts.join(first, "template", "left_semi").select("key", "template"), "key")
    inside = hits.groupBy(*_ANSWER, "size").agg(F.count("*").alias("revealed"), F.collect_set("template").alias("templates"))
    share = inside.select(F.explode("templates").alias("template"), (F.col("revealed") == F.col("size")).cast("int").alias("wholly")).groupBy("template").agg(F.avg("wholly").alias("share"))
    return share.where(F.col("share") >= HALF).select("template")


def plain_sentences(said: DataFrame, facts: DataFrame, revealed: DataFrame) -> DataFrame:
    """(key, template): the sentences that are none of substance."""
    loud = said.join(facts.join(revealed, "template", "left_semi").select("key"), "key", "left_semi").select(*_ANSWER).distinct()
    spoilt = said.join(loud, _ANSWER, "left_semi").groupBy("key").agg(F.count("*").alias("loud"))
    quiet = (F.col("n") > F.coalesce("loud", F.lit(0))).alias("quiet")
    words = F.split("text", " ")
    pairs = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat_ws(" ", w, F.element_at(words, i + 2)))
    couples = facts.join(spoilt, "key", "left").select("key", "template", quiet, F.explode(F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))).alias("couple"))
    known = couples.where("quiet").groupBy("couple").agg(F.min("template").alias("one"), F.max("template").alias("other"))
    covered = couples.join(known, "couple", "left").groupBy("key", "template").agg(F.avg(F.coalesce((F.col("one") != F.col("template")) | (F.col("other") != F.col("template")), F.lit(False)).cast("int")).alias("covered"))
    return covered.where(F.col("covered") < COVERED).select("key", "template")


def declining(judged: DataFrame, facts: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(templates, answers): (template, alone, n_prompts, n_answers) of the templates that decline, and
    (response_id, choice_index, template) of the answers that say nothing of substance."""
    said = cut(judged.select(*_ANSWER, "prompt_key", F.size("sentences").alias("size"), F.posexplode("sentences.key").alias("place", "key")))
    revealed = cut(revealed_templates(said, facts, prompts))
    plain = cut(plain_sentences(said, facts, revealed))
    spoken = said.join(plain, "key").groupBy(*_ANSWER, "prompt_key", "size").agg(F.count("*").alias("plain"), F.collect_list("template").alias("templates"))
    silent = cut(spoken.where("plain = size").join(prompts, "prompt_key", "left").select(*_ANSWER, "prompt", F.explode("templates").alias("template")))
    alone = silent.groupBy("template").agg(F.count("*").alias("silent"), F.countDistinct("prompt").alias("n_prompts"), F.countDistinct(*_ANSWER).alias("n_answers"))
    often = facts.groupBy("template").agg(F.sum("n").alias("n"))
    templates = alone.join(often, "template").withColumn("alone", F.col("silent") / F.col("n")).where((F.col("alone") >= HALF) & (F.col("n_prompts") >= MIN_PROMPTS))
    return templates.select("template", "alone", "n_prompts", "n_answers"), silent.select(*_ANSWER, "template")


def refused_answers(judged: DataFrame) -> DataFrame:
    """(response_id, choice_index) of the answers that decline by recurrence and say nothing of substance."""
    facts, prompts = opening_templates(judged)
    templates, silent = declining(judged, cut(facts), prompts)
    return silent.join(templates.select("template"), "template", "left_semi").select(*_ANSWER).distinct()


def read_once(responses: DataFrame) -> DataFrame:
    """(response_id, prompt, body) with one row per id; rows without id or body have no answers."""
    return responses.where("response_id is not null and body is not null").groupBy(F.col("response_id").cast("long").alias("response_id")).agg(F.max(F.struct("body", "prompt")).alias("r")).select("response_id", "r.prompt", "r.body")


def defective_answers(responses: DataFrame, documents: DataFrame) -> DataFrame:
    """(response_id, choice_index, defect) of every defective answer, one defect each.

    Null and unreadable bodies have no answers; a null prompt is an empty one, of no known language; repeated
    rows are read once; two choices with the same index are both judged; other columns are ignored; an empty
    table gives an empty result.
    """
    judged = cut(judge_answers(read_once(responses), fit_languages(responses, documents)))
    refused = refused_answers(judged).withColumn("refused", F.lit("refusal"))
    found = judged.select("response_id", "choice_index", "defect", "later").join(refused, ["response_id", "choice_index"], "left")
    return found.withColumn("defect", F.coalesce("defect", "refused", "later")).where("defect is not null").select("response_id", "choice_index", "defect")


def refusal_templates(responses: DataFrame, documents: DataFrame) -> DataFrame:
    """(template, text, n_sentences, declines, n_answers, n_prompts) of every template of openings; the last two
    for those that decline: their answers without substance and the unrelated prompts of these."""
    judged = cut(judge_answers(read_once(responses), fit_languages(responses, documents)))
    facts, prompts = opening_templates(judged)
    facts = cut(facts)
    templates, _ = declining(judged, facts, prompts)
    every = facts.groupBy("template").agg(F.min("text").alias("text"), F.sum("n").alias("n_sentences"))
    return every.join(templates, "template", "left").select("template", "text", "n_sentences", F.col("alone").isNotNull().alias("declines"), "n_answers", "n_prompts")

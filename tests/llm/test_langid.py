import pytest

from framewright.llm import langid

SENTENCES = {
    "en": ["The wide camera loses the ball behind the far goal.", "Nobody noticed it until later in the evening.", "Why does the picture shake so much here?", "The keeper stays on the line while the match goes on."],
    "es": ["La cámara central pierde el balón detrás de la portería.", "Nadie se dio cuenta hasta más tarde.", "¿Por qué tiembla tanto la imagen aquí?", "El portero visitante se queda con la pelota."],
    "de": ["Die mittlere Kamera verliert den Ball hinter dem Tor.", "Niemand hat es vorher gemerkt.", "Warum wackelt das Bild hier so stark?", "Der Torwart bleibt auf der Linie, während das Spiel läuft."],
    "fr": ["La caméra centrale perd le ballon derrière le but.", "Personne ne l'a vu avant le soir.", "Pourquoi l'image tremble-t-elle autant ici ?", "Le gardien reste sur sa ligne alors que le match continue."],
    "ja": ["広角カメラは奥のゴールの後ろでボールを見失った。", "誰も後まで気づかなかった。", "なぜここで画面がこんなに揺れるのか。", "キーパーは試合が続く間ラインに残った。"],
    "ru": ["Широкая камера теряет мяч за дальними воротами.", "Никто этого раньше не заметил.", "Почему здесь так дрожит картинка?", "Вратарь гостей остаётся на линии."],
}
SCHEMA = "doc_id long, text string, lang string, seg_no string"


@pytest.fixture(scope="module")
def table():
    labelled = [(k, " ".join(v[i:] + v[:i])) for k, v in SENTENCES.items() for i in range(4)]
    return langid.fit([*labelled, ("sv", " ".join(SENTENCES["en"])), ("fr", " ".join(SENTENCES["es"]))])


def found(text, table):
    return [s[0] for s in langid.segment_texts([text], table)[0]]


def test_labels():
    want = {"en-GB": "en", " English ": "en", "pt_BR": "pt", "deu": "de", "Español": "es", "??": None, "und": None, "unknown": None, "": None, " ": None, None: None}
    assert {k: langid.canonical_label(k) for k in want} == want


def test_segments(table):
    e, s, j = SENTENCES["en"], SENTENCES["es"], SENTENCES["ja"]
    assert found(" ".join(e), table) == ["en"]
    assert found(f"{e[0]} {e[1]}\n\n{s[0]} {s[1]} {j[0]}{j[1]}\n---\n{e[2]}", table) == ["en", "es", "ja", "en"]
    assert found(f"A banner reads 'immer weiter' behind the goal. {e[0]}", table) == ["en"]
    assert found(e[0].upper(), table) == ["en"]
    assert found('{"f": 1, "xyxy": [1.5, 2.0]}\n```\n[1, 2]\n```\n12;34.5;7', table) == []
    assert found("", table) == found(None, table) == found("⚽⚽ 3–2", table) == []


def test_wrong_labels_do_not_spoil_the_model(table):
    right = sum(found(x, table) == [k] for k, v in SENTENCES.items() for x in v)
    assert right >= 22


def test_found(spark, table):
    e, s = " ".join(SENTENCES["en"]), " ".join(SENTENCES["es"])
    rows = [(1, e, "en", ""), (2, e, "English", ""), (3, e, "fr", ""), (4, e, None, ""), (5, s, "??", ""), (6, f"{e}\n{s}", "en", ""), (7, None, "en", ""), (8, "", None, ""), (9, "⚽", None, ""), (None, e, None, ""), (3, e, "fr", "")]
    segments = langid.language_segments(spark.createDataFrame(rows, SCHEMA), table).where("label is null or segments > 1 or label <> lang")
    assert {(r["doc_id"], r["seg_no"], r["lang"]) for r in segments.collect()} == {(3, 0, "en"), (4, 0, "en"), (5, 0, "es"), (6, 0, "en"), (6, 1, "es")}
    assert langid.mislabelled_segments(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    place = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{place}/documents.parquet")
    model = langid.fitted(docs.where("doc_id % 2 = 0"))
    held = langid.language_segments(docs.where("doc_id % 2 = 1"), model).where("label is not null and segments = 1").toPandas()
    assert (held.lang == held.label).mean() > 0.85  # about a tenth of the labels is wrong


def test_confidence_is_calibrated(sf_dir):
    """On held-out phrases of one to four words the confidence is the share of right answers, within a tenth."""
    import os
    import random

    import numpy as np
    import pandas as pd

    docs = pd.read_parquet(os.path.join(os.path.dirname(sf_dir), "sf0.01", "documents.parquet")).drop_duplicates("text")
    labelled = [(langid.canonical_label(label), text) for label, text in zip(docs["lang"], docs["text"]) if text and langid.canonical_label(label) and len(text) < 6000]
    rng = random.Random(0)
    rng.shuffle(labelled)
    table = langid.fit(labelled[: len(labelled) // 2])
    held = labelled[len(labelled) // 2 :]
    phrases, right = [], []
    for (label, text), found in zip(held, langid.segment_texts([x for _, x in held], table)):
        if len(found) == 1 and found[0][0] == label:  # labels may be wrong
            for words in [x.split() for s in langid.sentences(text)[:8] if (x := langid.worded(s))]:
                k = rng.choice([1, 1, 2, 2, 3, 4])
                at = rng.randrange(max(1, len(words) - k + 1))
                phrases.append(f" {' '.join(words[at : at + k])} ")
                right.append(langid.LANGUAGES.index(label))
    ll = langid.scores(phrases, table)
    best = ll.argmax(axis=1)
    sure, ok = langid._confidence(ll, best), best == np.array(right)
    bins = np.digitize(sure, [0.5, 0.75, 0.9, 0.97])
    error = sum(abs(sure[bins == k].mean() - ok[bins == k].mean()) * (bins == k).mean() for k in set(bins))
    assert len(phrases) > 500 and ok.mean() > 0.8 and error < 0.1

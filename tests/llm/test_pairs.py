import json

import pytest

from framewright.llm import pairs

PROMPT = "Describe in a few sentences what happens in these frames and where the ball goes.\nMarked areas:\nid, color\nA, Amber\nB, Teal"
LISTED = "For each area say whether it holds the ball. Answer with a JSON array of objects with id, primary and reason.\nid, color\nA, Amber"
GOOD = "The wide camera follows the long pass without trouble. The keeper stays on the line while the match goes on."
REFUSAL = "I'm sorry, but I can't help with analysing these pictures."
SCHEMA = "response_id long, prompt string, body string, vendor string, defect string"


def gpt(*messages):
    return json.dumps({"choices": [m if m is None else {"index": i, "finish_reason": "stop", "message": m} for i, m in enumerate(messages)]})


def test_copies():
    assert pairs.is_copy(f'"{PROMPT.upper()}"', PROMPT) and pairs.is_copy("Marked areas:", PROMPT)
    assert not pairs.is_copy(f'"{PROMPT}" {GOOD}', PROMPT) and not pairs.is_copy("[]", PROMPT)


def test_ends():
    assert pairs.json_part('Here:\n[{"id": "A"}]')[0] == "json" and pairs.json_part("```json\n[]\n```")[0] == "json"
    assert pairs.json_part('[{"id": "A", "pri')[0] == "cut" and pairs.json_part('```json\n[{"id"')[0] == "cut"
    assert pairs.json_part(GOOD)[0] == "prose"
    assert not pairs.ends_within(GOOD) and not pairs.ends_within('He said "no."') and not pairs.ends_within("終わった。")
    assert pairs.ends_within("The wide camera gives way to the lo") and pairs.ends_within("It holds:") and pairs.ends_within("It is over. The keep", "stop")
    assert not pairs.ends_within("The left goal - 3 shots") and not pairs.ends_within("Area A") and not pairs.ends_within("It holds:\n- area A\n- area B", "stop")
    assert pairs.ends_within("Area A", "length") and pairs.ends_within("The left goal - 3 shots", "max_tokens")


def test_blank():
    assert all(map(pairs.is_blank, ["", " \n\t", "​", "```json\n```", "``` ```"])) and not pairs.is_blank("[]")


def test_asked_language():
    assert pairs.asked_language(pairs.request_of(PROMPT + "\n\nAnswer in German.")) == "de"
    assert pairs.asked_language("Beschreibe das Bild.\n\nAntworte auf Englisch.") == "en"
    assert pairs.asked_language(pairs.request_of(PROMPT)) is None


@pytest.fixture(scope="module")
def documents(spark):
    from test_langid import SENTENCES

    return spark.createDataFrame([(i, lang, " ".join(v)) for i, (lang, v) in enumerate(SENTENCES.items())], "doc_id long, lang string, text string")


def test_each_defect(spark, documents):
    from test_langid import SENTENCES

    german = " ".join(SENTENCES["de"])
    listed = lambda reason: json.dumps([{"id": "A", "primary": True, "reason": reason}])
    other = "Write a short account of this section.\nid, color\nC, Sky"
    rows = [
        (1, PROMPT, gpt({"content": GOOD}, {"content": None}, {"content": " "}, {"content": None, "tool_calls": [{"id": 1}]}, None)),
        (2, PROMPT, gpt({"content": REFUSAL + " Is there anything else you need?"}, {"content": None, "refusal": REFUSAL}, {"content": '{"error": "' + REFUSAL + '"}'})),
        (3, other, gpt({"content": REFUSAL}, {"content": f"I'm not able to tell where the ball is, but area C follows the play. {GOOD}"})),
        (4, PROMPT, gpt({"content": PROMPT}, {"content": f'"{PROMPT}" {GOOD}'}, {"content": "The wide camera follows the lo"})),
        (5, PROMPT, gpt({"content": german}, {"content": [{"type": "text", "text": GOOD[:20]}, {"type": "text", "text": GOOD[20:]}]})),
        (6, PROMPT + "\n\nAnswer in German.", gpt({"content": german}, {"content": GOOD})),
        (7, LISTED, json.dumps({"content": [{"type": "text", "text": listed(GOOD)}], "stop_reason": "end_turn"})),
        (8, LISTED, json.dumps({"content": [], "stop_reason": "end_turn"})),
        (9, LISTED, listed(german)),
        (10, LISTED, "[]"),
        (11, LISTED, "[{"),
        (12, LISTED, None),
        (13, None, gpt({"content": GOOD})),
        (14, LISTED, gpt({"content": "[]"}, {"content": '[{"id": "A", "primary": true}]'}, {"content": '[{"id": "A", "primary'})),
        (15, PROMPT, gpt({"content": GOOD})),
        (None, PROMPT, gpt({"content": ""})),
    ]
    df = spark.createDataFrame([(*r, "v", "x") for r in [*rows, rows[0]]], SCHEMA)
    found = {tuple(r) for r in pairs.defective_answers(df, documents).collect()}
    assert found == {
        (1, 1, "empty"), (1, 2, "empty"), (2, 0, "refusal"), (2, 1, "refusal"), (2, 2, "refusal"), (3, 0, "refusal"), (4, 0, "copied"), (4, 2, "truncated"),
        (5, 0, "other_language"), (6, 1, "other_language"), (8, 0, "empty"), (9, 0, "other_language"), (14, 2, "truncated"),
    }


REQUESTS = ["Say where the ball is.", "Name the players you see.", "Which camera moved first?", "Count the goals of the second half.", "Tell us about the weather.", "Is the pitch wet or dry today?"]
SUBJECTS = ["The wide camera", "A young keeper", "Our second detector", "The coach of the guests", "One spare ball", "The man at the mast"]
PREDICATES = ["follows the long pass without trouble", "stays on the line while the match goes on", "loses the track for nine frames", "needs another look by hand", "moves slowly towards the wrong goal"]
PARAPHRASED = ["That lies beyond what this service offers.", "We leave such matters to the referee and his team.", "Let us talk about something else."]


def test_refusals_recur_without_a_list(spark, documents):
    """Wordings that no list holds are refusals where they recur for unrelated prompts; a single doubt is none."""
    import itertools
    import random

    rng = random.Random(3)
    real = list(itertools.product(SUBJECTS, PREDICATES))
    rows, expected = [], set()
    for i in range(150):
        rows.append((i, REQUESTS[i % 6], gpt({"content": " ".join(f"{a} {b}." for a, b in rng.sample(real, rng.randint(2, 5)))})))
    for i, (request, text) in enumerate(itertools.product(REQUESTS, PARAPHRASED), 200):
        rows.append((i, request, gpt({"content": f"Good day. {text}" if i % 4 == 0 else text})))
        expected.add(i)
    rows.append((300, REQUESTS[0], gpt({"content": "I am not able to see any ball."})))
    rows += [(310 + i, REQUESTS[1], gpt({"content": "Nobody can be named from so far away."})) for i in range(6)]  # one prompt only
    rows += [(320 + i, r, gpt({"content": f"I cannot be sure about every single frame of it. {SUBJECTS[i]} {PREDICATES[i % 5]}."})) for i, r in enumerate(REQUESTS)]
    df = spark.createDataFrame([(*r, "v", "x") for r in rows], SCHEMA)
    refused = {r["response_id"] for r in pairs.defective_answers(df, documents).where("defect = 'refusal'").collect()}
    assert refused <= expected and len(refused) >= 0.9 * len(expected)


def test_empty(spark, documents):
    assert pairs.defective_answers(spark.createDataFrame([], SCHEMA), documents).count() == 0


def test_clusters_join_near_copies(spark):
    base = "please consult a human reviewer instead of asking me about this clip because it is not allowed here at all today"
    rows = [(1, base), (2, base + " x"), (3, "the wide camera follows the long pass without any trouble at the far goal"), (4, "hello")]
    found = {r["key"]: r["template"] for r in pairs.template_clusters(spark.createDataFrame(rows, "key long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}


def test_clusters_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    words = lambda n: [word() for _ in range(n)]
    common, texts = words(60), set()  # a hundred pairs of similarity 0.81 amid others of 0.74
    for _ in range(100):
        texts |= {" ".join([*common, *pair, *words(7)]) for pair in [words(3)] * 2}
    rows = [(pairs.hash_text(x), x) for x in sorted(texts)]
    grams = {k: {tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for k, x in rows}
    root = {k: k for k in grams}
    for a in grams:
        for b in grams:
            if a < b and root[a] != root[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= pairs.SIMILARITY:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    found = {r["key"]: r["template"] for r in pairs.template_clusters(spark.createDataFrame(rows, "key long, text string")).collect()}
    assert found == root

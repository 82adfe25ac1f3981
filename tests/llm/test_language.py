"""Language labels: held-out accuracy, spans of mixed texts, exact search, odd rows."""

import itertools
import unicodedata
import zlib

import numpy as np
import pyarrow as pa

from topicpulse.llm import language

SAMPLE = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.op11_language(spark, SAMPLE).collect()
    assert len(rows) == len(true) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == true[r.doc_id] for r in rows if r.held_out and true[r.doc_id] is not None]
    assert np.mean(held) >= 0.97 and all(0 <= r.score <= 1 for r in rows)


def _best_path(emission, cost):
    n, k = emission.shape
    def worth(path):
        return sum(emission[t, s] - (cost[t] if t and s != path[t - 1] else 0) for t, s in enumerate(path))
    return max(worth(p) for p in itertools.product(range(k), repeat=n)), worth


def test_viterbi_is_exact(monkeypatch):
    random = np.random.default_rng(1)
    for segment in (1, 2, 3, 256):
        monkeypatch.setattr(language, "SEGMENT", segment)
        for _ in range(20):
            n, k = random.integers(1, 8), random.integers(2, 4)
            emission, cost = -random.random((n, k)) * 3, np.where(random.random(n) < 0.2, 0.0, 1.5)
            best, worth = _best_path(emission, cost)
            assert abs(worth(language.viterbi(emission, cost).tolist()) - best) < 1e-9
    assert language.viterbi(np.zeros((0, 3)), np.zeros(0)).size == 0


def test_words_against_a_plain_loop():
    texts = ["Ab,cd é́x ΑΒab", "", "漢字kana カナ1x", "́a b́", "ไทย9", "\U0001d4d0 𠀀𠀁z", None]
    kind = lambda c: unicodedata.category(c)[0]
    script_of = lambda c: next((n for n, a, b in language.SCRIPTS if a <= ord(c) <= b), "other")
    want = []
    for i, text in enumerate(texts):
        word = None
        for at, c in enumerate(text or ""):
            if kind(c) not in "LM":
                word = None
                continue
            base = script_of(c)
            if kind(c) == "M":
                if word is None:
                    word = [i, at, at, "mark", 0]
                    want.append(word)
                word[2] = at + 1
                continue
            if word is None or word[3] != base or base in language.UNSPACED:
                word = [i, at, at, base, 0]
                want.append(word)
            word[2] = at + 1
            word[4] += 1
    want = [tuple(w[:3]) for w in want if w[4]]
    w = language.LetterWords(pa.array(texts))
    got = [(int(t), int(s - w.offsets[t]), int(e - w.offsets[t])) for t, s, e in zip(w.text, w.start, w.end)]
    assert got == want


def test_mixed_texts_scripts_and_odd_rows(spark):
    en = "the house of the old man was on the hill and the river ran below it "
    de = "das haus des alten mannes stand auf dem hügel und der fluss floss darunter "
    ru = "дом старого человека стоял на холме и река текла внизу "
    rows = [(i, [en, de, ru][i % 3] * 4, ["en", "de", "ru"][i % 3]) for i in range(60)]
    docs = spark.createDataFrame([*rows, (61, en, None), (None, "zzz", "xx")], SCHEMA)
    model = language.fit(docs)
    assert model.languages == ["de", "en", "ru"] and model.writes[language.NAMES.index("cyrillic")].tolist() == [False, False, True]
    odd = [(1, en * 2 + de * 2 + ru, "x"), (2, None, "en"), (3, "", "en"), (4, "123 !?", "en"), (5, "Ω", "en"), (6, "the", None), (6, "the", None),
           (None, ru, None), (7, de * 20_000, None)]
    asked = spark.createDataFrame(odd, SCHEMA)
    for name in ("spans", "score", "lang_pred", "held_out", "n"):
        asked = asked.selectExpr("*", f"7 AS {name}")
    got = {(r.doc_id, r.lang_pred): r for r in language.label(asked, model).collect()}
    mixed = got[1, "de"]
    assert [s.lang for s in mixed.spans] == ["en", "de", "ru"] and 0.3 < mixed.score < 0.5
    assert mixed.spans[0].start == 0 and abs(mixed.spans[1].start - 2 * len(en)) <= 12 and mixed.spans[2].start == 2 * len(en + de)
    assert {k for k in got if k[1] == "und"} == {(2, "und"), (3, "und"), (4, "und")} and all(got[k].score == 0 for k in got if k[1] == "und")
    assert (6, "en") in got and (None, "ru") in got and (7, "de") in got and got[7, "de"].score == 1.0
    assert next(p for i, p in got if i == 5) in model.languages
    assert language.label(asked, model).count() == len(odd) and language.label(asked.limit(0), model).count() == 0
    assert language.fit(docs.limit(0)) is None and {r.lang_pred for r in language.label(asked, None).collect()} == {"und"}

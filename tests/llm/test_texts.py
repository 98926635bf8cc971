"""Sentences, languages, packing and mixing: stated cases, exact round trips, held-out accuracy, invariants."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoloom.llm import languages, mixing, packing, sentences, tokens

CASES = [
    ("Some limits, e.g. the scheduler, do not apply. See Fig. 3 and Sec. 4.2 now.", 2),
    ("It costs 3.14 GB. Since ver. 2.0.1, all is well.The next one has no blank.", 3),
    ('The log shows "Task held. Check limits!" until it recovers. Finally it prints "all done." The end.', 3),
    ('"Who owns it?" is a question. Why?! Because.', 3),
    ("At 10 a.m. Central Time it starts. It always ends at 5 p.m. The rest waits.", 3),
    ("Nodes, queues, etc. Why stop? Edit x.conf, etc. before it starts.", 3),
    ("1. First item.\n2. Second item\nwhich goes on.\n\nHeading\n\nqpush --nodes=3 run.sh\n\nText", 5),
    ("It waits ... and then starts. Done.", 2),
    ("Am 3. Mai um 8.30 Uhr. Siehe Abb. 4 bzw. Abschn. 5. Manche, z. B. diese, d. h. alle.", 3),
    ("Das Protokoll meldet „Halt. Bitte warten!“, bis es geht. Ende.", 2),
    ("La tâche s’arrête ! Certaines limites, p. ex. le quota, c.-à-d. tout. « Arrêt. Voir ! » tant que rien.", 3),
    ("¿Por qué? ¡No! Véase la fig. 3 y el apdo. 2,1. (Véase el núm. 6.) Fin.", 5),
    ("Узлы, квоты и т. д. Модуль, т. е. файл, ок. 5 МБ. См. рис. 2.", 3),
    ("日志显示“任务已挂起。请检查！”，直到恢复。第二句！第三句？", 3),
    ("「誰のですか？」という質問。しばらく待つと……再開します。倍率は３．５です。", 3),
    ("क्र. 20 में है। दूसरा वाक्य! तीसरा?", 3),
    ("THE MESSAGE \"NO SLOTS LEFT.\" REFERS TO IT. SEE FIG. 3. AT 5 P.M. THE END.", 3),
    ("", 0),
    (" \n\n  ", 0),
]


@pytest.mark.parametrize(("text", "n"), CASES)
def test_units(text, n):
    u = sentences.units(text)
    assert len(u) == n, [text[s:e] for s, e in u]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='aB .!?"“”«»\n1()e.g。「」A', max_size=80))
def test_units_cover_the_text(text):
    u = sentences.units(text)
    assert all(s < e and not text[s].isspace() and not text[e - 1].isspace() for s, e in u) and all(a[1] <= b[0] for a, b in zip(u, u[1:]))
    left = set(range(len(text))) - {i for s, e in u for i in range(s, e)}
    assert all(text[i].isspace() for i in left)


def test_segment(spark):
    df = spark.createDataFrame([(1, "A one. B two.", 9), (1, "A one. B two.", 9), (2, None, 9), (3, "", 9), (None, "C.", 9), (4, "word " * 200_000 + "end.", 9)], "doc_id long, text string, sent_idx int")
    got = sentences.segment(df).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 4, None: 1, 4: 1}
    assert sentences.segment(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def identifier(spark, data):
    return languages.fit(spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet"), rows_per_language=60)


HELD_OUT = {
    "en": "The night train leaves the old station at noon. We walked along the river and talked about nothing.", "de": "Der Nachtzug verlässt den alten Bahnhof am Mittag. Wir gingen am Fluss entlang und redeten über nichts.",
    "fr": "Le train de nuit quitte la vieille gare à midi. Nous avons marché le long de la rivière sans rien dire.", "es": "El tren nocturno sale de la vieja estación al mediodía. Caminamos junto al río y no hablamos de nada.",
    "pt": "O comboio da noite sai da velha estação ao meio-dia. Caminhámos junto ao rio e não falámos de nada.", "ru": "Ночной поезд уходит со старого вокзала в полдень. Мы шли вдоль реки и ни о чём не говорили.",
    "zh": "夜间列车中午离开旧车站。我们沿着河边走，什么也没说。", "ja": "夜行列車は正午に古い駅を出ます。私たちは川に沿って歩き、何も話しませんでした。", "hi": "रात की रेल दोपहर को पुराने स्टेशन से जाती है। हम नदी के किनारे चले और कुछ नहीं बोले।",
}


def test_held_out_languages(spark, identifier):
    rows = [(i, t) for i, t in enumerate(HELD_OUT.values())]
    got = {r.doc_id: r.lang for r in languages.language_stretches(spark.createDataFrame(rows, "doc_id long, text string"), identifier).collect()}
    assert got == dict(enumerate(HELD_OUT))


UNKNOWN = {
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.", "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다.", "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
}


def test_other_languages_stay_unknown(spark, identifier):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(UNKNOWN.values())] + [(9, f"{UNKNOWN['el']} {HELD_OUT['en']}")], "doc_id long, text string")
    got = languages.language_stretches(df, identifier).collect()
    assert {r.doc_id: r.lang for r in got} == {0: "und", 1: "und", 2: "und", 3: "und", 9: "en"} and all(0 < r.confidence <= 1 for r in got)
    assert languages.document_languages(languages.language_stretches(df, identifier)).where("lang = 'und'").count() == 4


def test_without_any_label(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate([*HELD_OUT.values(), UNKNOWN["el"], UNKNOWN["ko"], UNKNOWN["ar"], None, ""])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in languages.language_stretches(df, languages.fit(df)).collect()}
    assert [got[i] for i in (9, 10, 11)] == ["und"] * 3 and set(got) == set(range(12))
    want = list(HELD_OUT)
    assert sum(got[i] == g for i, g in enumerate(want)) >= 8 and all(got[i] in (g, "und") for i, g in enumerate(want))
    assert languages.Identifier({}).model.languages == languages.LANGUAGES


def test_confidence_is_calibrated(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    sample = languages.training_units(docs, 80)
    ident = languages.Identifier({g: t[:40] for g, t in sample.items()})
    held = {g: sorted({u[i : i + 9] for t in texts[40:] for u in t for i in range(0, len(u) - 8, 30)}) for g, texts in sample.items()}
    texts = [(g, u) for g, us in held.items() for u in us]
    total, _ = ident.model.score([u for _, u in texts])
    p = ident.posterior(-total)
    # labels are wrong in part, so the bounds are wide
    right = np.array([g for g, _ in texts]) == np.array(ident.model.languages)[p.argmax(1)]
    for low, high in ((0.35, 0.7), (0.7, 0.9), (0.9, 0.99)):
        at = (p.max(1) >= low) & (p.max(1) < high)
        assert at.sum() > 30 and abs(right[at].mean() - p.max(1)[at].mean()) < 0.25


def test_clean_folds_and_drops_code():
    got = languages.clean(["Édite x.conf ou run_2 !", "qpush --nodes=3 run.sh", "a\x1eb", "", "ǆ Ĳ", "Er sagte „ja“ und ging."])
    assert got == [" edite ou ", "", " a b ", "", " dz ij ", " er sagte und ging "]
    assert languages.clean([]) == []


def test_mixed_and_odd_texts(spark, identifier):
    a, b = HELD_OUT["en"], HELD_OUT["de"]
    text = f"{a}\n\nqpush --nodes=3 run_x.sh\n\n{b}\n\n{a}"
    rows = [(1, text, "q"), (2, None, "q"), (3, "", "q"), (4, "12 34", "q"), (5, a.upper(), "q"), (6, "jstat --x=1 a.sh", "q"), (1, text, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = languages.language_stretches(df, identifier).orderBy("doc_id", "start_char").collect()
    one = [(r.start_char, r.lang) for r in got if r.doc_id == 1]
    assert sorted(set(one)) == [(0, "en"), (text.index(b), "de"), (text.rindex(a), "en")] and len(one) == 6
    assert [(r.doc_id, r.lang) for r in got if r.doc_id != 1] == [(5, "en")] and all(0 < r.confidence <= 1 for r in got)
    assert languages.language_stretches(df.limit(0), identifier).count() == 0
    assert {r.doc_id: (r.lang, r.n_languages) for r in languages.document_languages(languages.language_stretches(df, identifier)).collect()} == {1: ("en", 2), 5: ("en", 1)}


def test_agrees_with_labels(spark, data, identifier):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("lang in ('en','de','fr','es','pt','ru','zh','ja','hi') and length(text) > 50")
    got = languages.document_languages(languages.language_stretches(docs, identifier)).join(docs.select("doc_id", F.col("lang").alias("label")), "doc_id")
    n = got.count()
    assert n > 40 and got.where("lang = label").count() >= 0.85 * n  # labels are partly wrong


def test_score_in_pieces(identifier):
    t = [" the job queue waits for the node ", "", " die warteschlange "]
    a, _ = identifier.model.score(t)
    assert (identifier.model.score([t[0] * 3 + t[2]], at_once=20)[1] == len(t[0]) * 3 + len(t[2])).all() and (a[1] == 0).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=300))
def test_assign(sizes):
    t = np.array(sorted(sizes, reverse=True))
    at = packing.assign(t, 100)
    per = np.bincount(at, t)
    assert per.max() <= 100 and (per > 0).sum() <= 2 * -(-t.sum() // 100)


def test_pack(spark):
    rnd = random.Random(4)
    rows = [(i, min(4096, int(rnd.lognormvariate(5, 1)) + 1)) for i in range(3000)] + [(5000, 10_000), (5001, 4096), (5002, 0)]
    counts = spark.createDataFrame(rows, "id long, tokens long")
    got = packing.pack(None, 4096, containers_per_shard=32, counts=counts).collect()
    size, parts = {}, {}
    for r in got:
        size[r.container] = size.get(r.container, 0) + r.tokens
        parts.setdefault(r.id, []).append((r.first_token, r.tokens))
    assert max(size.values()) <= 4096 and sum(size.values()) / (4096 * len(size)) > 0.95
    assert {i: sum(n for _, n in p) for i, p in parts.items()} == {i: n for i, n in rows if n}
    assert sorted(parts[5000]) == [(0, 4096), (4096, 4096), (8192, 1808)] and all(len(p) == 1 for i, p in parts.items() if i != 5000)
    assert packing.pack(None, counts=counts.limit(0)).count() == 0


def test_pack_texts(spark):
    df = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1), (2, None, 1), (3, "", 1), (None, "x", 1), (4, "é" * 5000, 1)], "doc_id long, text string, tokens int")
    got = {r.id: r.tokens for r in tokens.token_counts(df).collect()}
    assert set(got) == {1, 4} and got[1] == 3
    assert sum(r.tokens for r in packing.pack(df, capacity=64).collect()) == sum(got.values())


def test_dual_tilts_by_length():
    rng = np.random.default_rng(1)
    lengths = [np.maximum(1, rng.lognormal(5, 1, 4000)).round(), np.maximum(1, rng.lognormal(6, 0.5, 500)).round(), rng.integers(10, 2000, 900).astype(float), np.full(50, 7.0)]
    most, share = np.array([1, 6, 3, 9]), np.array([0.2, 2.5, 0.7, 9.0])
    have = np.array([x.sum() for x in lengths])
    want = have * share
    rates = lambda v: [np.minimum(m, np.exp(np.minimum(50, a * x / x.mean()))) for a, x, m in zip(v, lengths, most)]
    def moments(v):
        r = rates(v)
        return np.array([[(q * x).sum(), (q * x * x / x.mean())[q < m].sum()] for q, x, m in zip(r, lengths, most)])
    v = mixing.solve(moments, want, have, most)
    r = rates(v)
    assert v[0] < -0.1 and v[1] > 0.1 and v[2] < -0.1 and np.isinf(v[3])
    assert all(abs((q * x).sum() / w - 1) < 1e-6 and q.max() <= m for q, x, w, m in zip(r, lengths, want, most))
    # least relative entropy: no exchange of tokens between two documents of a source lowers it
    entropy = lambda q: (q * np.log(np.maximum(q, 1e-300)) - q).sum()
    for q, x, m in zip(r[:3], lengths, most):
        for i, j in rng.integers(0, len(x), (200, 2)):
            p = q.copy()
            p[i] += 0.01 / x[i]
            p[j] -= 0.01 / x[j]
            if i != j and p[i] <= m and p[j] >= 0:
                assert entropy(p) >= entropy(q) - 1e-9


def test_mix(spark):
    rnd = random.Random(7)
    rows = [(i, "Big_One" if i % 3 == 0 else "big-one " if i % 3 == 1 else "mid", rnd.randrange(1, 2000)) for i in range(6000)] + [(9000 + i, "small", rnd.randrange(100, 900)) for i in range(40)] + [(9900, None, 5), (9901, "other", 5)]
    counts = spark.createDataFrame(rows, "id long, source string, tokens long")
    targets = spark.createDataFrame([("big one", 0.5, 1), ("mid", 0.4, 2), ("small", 0.05, 6), ("absent", 0.05, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(None, targets, counts=counts)
    use = {r.source: r for r in mixing.shares(got, targets).collect()}
    assert abs(use["big_one"].actual_share - 0.5 / 0.95) < 0.01 and abs(use["small"].actual_share - 0.05 / 0.95) < 0.01 and use["absent"].tokens == 0
    assert use["big_one"].most_copies <= 1 and use["mid"].most_copies <= 2 and use["small"].most_copies <= 6 and {r.source for r in got.select("source").distinct().collect()} == {"big_one", "mid", "small"}
    rate = {r.id: r.rate for r in got.collect()}
    size, source = {i: t for i, _, t in rows}, {i: s for i, s, _ in rows}
    mids = sorted((size[i], rate[i]) for i in rate if source[i] == "mid")
    assert mids[0][1] != mids[-1][1] and all(abs(np.log(a[1]) / a[0] - np.log(mids[0][1]) / mids[0][0]) < 1e-4 for a in mids if 0 < a[1] < 2 and a[0] > 50)
    assert mixing.mix(None, targets, counts=counts.limit(0)).count() == 0 and mixing.mix(None, targets.limit(0), counts=counts).count() == 0
    fixed = mixing.shares(mixing.mix(None, targets, total_tokens=50_000, counts=counts), targets)
    assert abs(fixed.agg(F.sum("tokens")).first()[0] - 50_000) < 1500

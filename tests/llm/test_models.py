"""Classifiers by held-out accuracy, language profiles by brute force, quotations by hand, and the pipeline."""

import os
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from stockline.llm import language, toxicity
from stockline.llm.common import table
from stockline.llm.language import LanguageModel, language_profiles, predict_languages
from stockline.llm.quality import fit_quality, score_quality
from stockline.llm.quotations import link_replies
from stockline.llm.toxicity import fit_toxicity, letter_stream, score_toxicity

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")


def tables(spark):
    return table(spark, SF, "documents"), table(spark, SF, "labels")


def odd_rows(spark):
    return spark.createDataFrame([(None, None, None, "s", 1), (1, "", "en", "s", 1), (1, "", "en", "s", 1), (2, "123 !!", "en", None, 2),
                                  (3, "word " * 20_000, None, "s", 0)], "doc_id bigint, text string, lang string, score string, label int")


@pytest.mark.parametrize("fit, score, label, least", [(fit_quality, score_quality, "quality", 0.95),
                                                      (fit_toxicity, score_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, fit, score, label, least):
    docs, labels = tables(spark)
    model = fit(docs, labels)
    rows = score(docs, model, 0.7).join(labels, "doc_id").where(f"held_out and {label} is not null").collect()
    assert sum(r.predicted == r[label] for r in rows) >= least * len(rows) > 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert score(odd_rows(spark), model, 0.7).count() == 5
    assert score(docs.where("false"), model, 0.7).count() == 0
    none = fit(docs, labels.where("false"))
    assert score(odd_rows(spark), none, 0.7).select("score").distinct().count() == 1


def test_toxicity_tolerates_gaps_and_inserted_characters(spark):
    docs, labels = tables(spark)
    model = fit_toxicity(docs, labels)
    clean = max(model.margin(t) for t in ("The and of the ning erthe.", "Der die das und ein.", ""))
    for text in ("you worthless thing", "you w-o-r-t-h-l-e-s-s thing", "you worth*less thing", "you worthhless thing",
                 "you w o r t h l e s s thing"):
        assert model.margin(text) > clean, text
    assert letter_stream("i d i o t").tolist() == letter_stream("idiot").tolist()
    assert model.margin("αβγδ 123 漢字") == 0


def sentences(alphabet, insults, rng, spaced=True):
    """Labelled texts in some alphabet: invented words, and in every second one an insult."""
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows = []
    for k in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(8, 40))]
        if k % 3 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(insults))
        rows.append((k, (" " if spaced else "").join(text) + ".", int(k % 3 == 0)))
    return rows


@pytest.mark.parametrize("name, alphabet, insults", [
    ("Cyrillic", "абвгдежзийклмнопрстуфхцчшщъыьэюя", ["придурок", "сволочь", "мразь", "гад"]),
    ("Greek", "αβγδεζηθικλμνξοπρστυφχψω", ["ηλίθιος", "βλάκας", "ζώο", "σκουπίδι"]),
    ("Chinese", "的一是不了人我在有他这中大来上个国和也子时道说出得会自着", ["白痴", "傻瓜", "混蛋", "废物"]),
    ("Latin", "abcdefghijklmnoprstuvwz", ["idiot", "scum", "ass", "dümmling"])])
def test_toxicity_in_every_script(spark, name, alphabet, insults):
    rows = sentences(alphabet, insults, random.Random(5), name != "Chinese")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    found = score_toxicity(docs, fit_toxicity(docs, labels), 0.7).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in found if r.toxic]
    alone = [1 - r.predicted for r in found if not r.toxic]
    assert len(caught) > 50 and len(alone) > 100
    assert sum(caught) >= 0.95 * len(caught) and sum(alone) >= 0.95 * len(alone)


def plain_features(word, edges):
    """Subsequences of four symbols over at most six places, by trying all places."""
    symbols, found = (" " + word + "      " if edges else word), Counter()
    for chosen in combinations(range(len(symbols)), 4):
        letters = [symbols[k] for k in chosen]
        if chosen[3] - chosen[0] < 6 and " " not in letters[1:3] and (edges or " " not in letters):
            found["".join(letters)] += 0.6 ** (chosen[3] - chosen[0] - 3)
    return found


def test_kernel_and_landmarks_match_the_plain_kernel():
    words = ["worthless", "idiotic", "scum", "ass ", "it ", "xyzzy"]
    landmarks = toxicity.Landmarks(words)
    plain = [plain_features(w.strip(), len(w.strip()) < 4) for w in words]
    norms = [sum(v * v for v in f.values()) ** 0.5 for f in plain]

    def kernel(f, g):
        return sum(v * g.get(k, 0.0) for k, v in f.items())

    gram = [[kernel(f, g) / (n * m) for g, m in zip(plain, norms, strict=True)] for f, n in zip(plain, norms, strict=True)]
    assert np.allclose(landmarks.rows.T @ landmarks.rows, gram)
    assert np.allclose(landmarks.whiten @ landmarks.whiten @ np.array(gram), np.eye(len(words)), atol=1e-6)
    for text in ("you worthhless scum", "an ass it is", "xyz zy", "wo rthless"):
        whole = plain_features(text, True)
        by_kernel = np.array([kernel(whole, f) / n for f, n in zip(plain, norms, strict=True)])
        stream = letter_stream(text)
        assert np.allclose(landmarks.map(landmarks.sums(stream)), by_kernel @ landmarks.whiten)
        model = toxicity.ToxicityModel(0.5)
        weights = np.random.default_rng(1).normal(size=len(words))
        model.learned(landmarks.alphabet, landmarks.numbers, landmarks.fold(weights))
        assert np.isclose(model.position_weights(stream).sum(), by_kernel @ landmarks.whiten @ weights, atol=1e-4)


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = Counter()
    for word in words:
        padded = f" {word} "
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                if padded[k:k + n].strip():
                    found[padded[k:k + n]] += 1
    return found


def brute_code(gram):
    return sum(ord(c) << 21 * k for k, c in enumerate(gram))


class PlainWindows:
    """In the place of landmarks: an example is its window's letter codes."""

    @staticmethod
    def sums(stream):
        return stream

    map = sums


def test_example_windows_reach_the_end_of_a_text():
    for n in (9, 12, 15, 16, 100):
        text = ". ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}word" for k in range(n))
        windows = [letter_stream(w).astype("float32").tobytes() for w in text.split(". ")]
        telling = frozenset(stem for _, of in toxicity.places(text) for stem in of)
        for label in (0, 1):
            batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([label], pa.int32())], ["text", "label"])
            examples = toxicity._examples(PlainWindows, telling)(iter([batch]))
            found = [e for b in examples for e in b["example"].to_pylist()]
            if label:  # every telling word
                assert found == windows
                continue
            places = [windows.index(e) for e in found[1:]]  # the first one stands for the whole text
            assert len(places) == 8 and places[0] == 0 and places[-1] == n - 1
            steps = [b - a for a, b in zip(places, places[1:], strict=False)]
            assert min(steps) >= 1 and max(steps) - min(steps) <= 1


def test_profiles_and_distances_match_brute_force(spark):
    docs = table(spark, SF, "documents").where("doc_id < 60")
    rows = docs.selectExpr("doc_id", "text", "lang", "crc32(cast(doc_id as string)) % 5 = 0 as held").collect()
    counts = {}
    for r in rows:
        if not r.held and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    want = {lang: [brute_code(g) for g, _ in sorted(c.items(), key=lambda x: (-x[1], brute_code(x[0])))[:language.PROFILE]]
            for lang, c in counts.items()}
    profiles = language_profiles(docs)
    assert profiles == want
    found = {r.doc_id: r for r in predict_languages(docs, LanguageModel(profiles)).collect()}
    for r in rows:
        own = [brute_code(g) for g, _ in sorted(brute_grams(r.text).items(), key=lambda x: (-x[1], brute_code(x[0])))]
        own = own[:language.PROFILE]
        apart = {lang: sum(abs(p.index(g) - k) if g in p else language.PROFILE for k, g in enumerate(own))
                 for lang, p in want.items()}
        assert found[r.doc_id].lang_pred == min(sorted(apart), key=apart.get)
        assert found[r.doc_id].held_out == r.held


def test_languages_of_odd_rows(spark):
    docs = table(spark, SF, "documents")
    model = LanguageModel(language_profiles(docs))
    rows = predict_languages(odd_rows(spark), model).collect()
    assert Counter(r.lang_pred for r in rows)["und"] == 4
    held = predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in predict_languages(docs, LanguageModel(language_profiles(docs.where("false")))).collect()} == {"und"}


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?\n\nSecond part."), (1, 1, "assistant", "> Hello  THERE.\n> How are you?\nFine."),
        (1, 2, "user", ">> hello there.\n>> how are you?\n> fine.\nGood to hear."), (1, 3, "user", "> never said\nUnknown"),
        (1, 4, "assistant", "> Second part.\nAn answer to a part.\n> > Hello there."), (1, 5, "user", "> good to hear.\n\nLast"),
        (2, 0, "user", "> Hello there.\nOther conversation"), (1, 6, "user", None), (3, None, "user", "> x"), (None, 0, "user", ""),
        (4, 0, "user", "same"), (4, 1, "user", "same"), (4, 2, "user", "> same"), (4, 2, "user", "> same"),
        (1, 7, "user", "> How are you?\n> Fine.\n> Good to hear.\n> Last\nmixed lines")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, row int")
    found = {(r.conv_id, r.turn): r for r in link_replies(docs).collect()}
    assert link_replies(docs).count() == len(rows) and link_replies(docs.where("false")).count() == 0
    assert {k: (r.reply_to, r.root_turn, r.depth) for k, r in found.items() if k[0] == 1} == {
        (1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (1, 0, 2), (1, 3): (None, 3, 0), (1, 4): (0, 0, 1), (1, 5): (2, 0, 3),
        (1, 6): (None, 6, 0), (1, 7): (5, 0, 4)}
    assert found[1, 1].text == "Fine." and found[1, 2].text == "Good to hear." and found[1, 3].n_quotes == 1
    assert found[1, 2].n_quotes == 2 and found[1, 2].n_linked == 2 and found[1, 3].n_linked == 0
    assert found[2, 0].reply_to is None and found[4, 2].reply_to == 0 and found[3, None].reply_to is None


def test_reply_chains_of_any_length(spark):
    rows = [(1, k, f"> body {k - 1}\nbody {k}" if k else "body 0") for k in range(70)]
    found = link_replies(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows],
                                               "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted((r.turn, r.root_turn, r.depth) for r in found) == [(k, 0, k) for k in range(70)]


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents").where("doc_id < 300")
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, "", "en", None, 0), (5001, "1 2 3", "en", "x", 5)], docs.schema)
    docs = docs.unionByName(odd).withColumn("score", docs["n_chars"])
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.exceptAll(docs).count() == 0
        seen[name], docs = out, out
    labels = table(spark, SF, "labels")
    kept = seen["quality"].join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.97 * kept.count()
    assert seen["language"].where("text is null or text = '1 2 3'").count() == 0
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    best = seen["language"].selectExpr("doc_id", f"{folded} as folded").groupBy("folded").agg({"doc_id": "max"})
    assert {r.doc_id for r in seen["exact_dedup"].collect()} == {r[1] for r in best.collect()}
    assert seen["packing"].select("doc_id").distinct().count() == seen["near_dedup"].count()

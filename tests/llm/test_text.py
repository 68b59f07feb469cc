"""Operators 1, 4, 6, 8 and 9: brute force, round trips and held-out accuracy."""
import hashlib
import math
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay_spark.llm import chat_tree
from assay_spark.llm.chat_tree import conversation_messages, escape, format_trees, learned_text, read_back, unescape
from assay_spark.llm.lang_crf import Chains, accept, fit_language_model, forward_backward, held_out, identify, label_words, word_features
from assay_spark.llm.site_quality import combine, judge
from assay_spark.llm.syncmers import K, anchors, fingerprint_documents, fingerprint_edits

SF = "/root/testdata/sf0.001"


# --- language ID ---

def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 4, 2])
    chains, t = Chains.of(lengths), np.exp(rng.normal(size=(3, 3)))
    e = np.exp(rng.normal(size=(10, 3)))
    steps = np.empty_like(e)
    steps[chains.place] = e
    got = forward_backward(steps, chains, t)[2][chains.place]
    at = 0
    for n in lengths.tolist():
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = np.prod([e[at + k, y] for k, y in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:])])
            for k, y in enumerate(path):
                want[k, y] += w
        assert np.allclose(got[at:at + n], want / want.sum(1, keepdims=True))
        at += n


def test_word_features_depend_on_the_word_alone():
    many = word_features(["the", "a", "x" * 80, "théâtre"])
    for k, w in enumerate(["the", "a", "x" * 80, "théâtre"]):
        assert (word_features([w])[0] == many[k]).all()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_language_model(docs.where(~held_out()), per_lang=40)
    got = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out()).collect()
    assert len(got) > 40
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_code_switch_and_edges(spark, docs, empty):
    en = "the cat and the dog were there with them\nthis thing is for the other one"
    fr = "le chat et le chien sont avec nous dans la maison\nune autre chose est pour les gens"
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(40)]
    model = fit_language_model(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    mixed = spark.createDataFrame([(1, "the cat and the dog le chat et le chien")], "doc_id int, text string")
    words = label_words(mixed, model).first()["words"]
    assert [w["lang"] for w in words] == ["en"] * 5 + ["fr"] * 5
    got = {r["doc_id"]: r for r in identify(docs, model).collect()}
    assert len(got) == 10 and identify(docs, model).count() == docs.count()
    for i in (3, 4, 5, 8):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[1]["lang_pred"] == "en" and got[6]["lang_pred"] == "fr" and got[7]["n_words"] == 6001
    assert accept(docs, model, 0.4).columns == docs.columns
    none = fit_language_model(empty)
    assert {r["lang_pred"] for r in identify(docs, none).collect()} == {"und"}
    assert identify(empty, model).count() == 0


# --- conversations ---

def test_escapes_round_trip():
    rng = random.Random(4)
    for _ in range(300):
        s = "".join(rng.choice(["\\", "<", ">", "b", "l", "g", "</turn>\n", "<turn:user>\n", "\n", "é"]) for _ in range(rng.randrange(12)))
        assert unescape(escape(s)) == s and "<" not in escape(s) and ">" not in escape(s)


def test_trees_against_recursion(spark):
    rng = random.Random(6)
    rows = [(f"m{k:03}", f"m{rng.randrange(max(0, k - 8), k):03}" if k % 17 else None, "user" if k % 2 else "assistant",
             f"t{k} </turn>\n\\", rng.choice([0.0, 1.0, 2.5, None])) for k in range(150)]
    rows += [("o1", "absent", None, None, 1.0), ("s1", "s1", "user", "", 0.0)]
    by, kids = {r[0]: r for r in rows}, {}
    for r in rows:
        kids.setdefault(r[1], []).append(r[0])
    want = {}
    for r in rows:
        if not [c for c in kids.get(r[0], []) if c != r[0]]:
            path, at = [r[0]], r[1]
            while at in by and at != path[-1]:
                path.append(at)
                at = by[at][1]
            want.setdefault(path[-1], []).append((-sum(by[i][4] or 0.0 for i in path), r[0], path[::-1]))
    df = spark.createDataFrame([(*r, 7) for r in rows], "id string, parent string, role string, text string, score double, n int")
    got = {}
    for r in format_trees(df, branches=2).collect():
        turns = read_back(r["formatted"])
        loss = "".join(x for role, x in turns if role == "assistant")
        assert learned_text(r["formatted"], r["loss_spans"]) == loss and r["n_turns"] == len(turns)
        got.setdefault(r["root"], []).append((r["rank"], r["path"], turns))
    assert got.keys() == want.keys()
    for root, leaves in want.items():
        best = [(k + 1, leaf, [(by[i][2] or "", by[i][3] or "") for i in path]) for k, (_, leaf, path) in enumerate(sorted(leaves)[:2])]
        assert sorted(got[root]) == best


def test_linear_conversations_and_cycles(spark, monkeypatch):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, None, None, "first"), (None, 5, "user", "x"), (2, 0, "user", "")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(70)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id bigint, turn bigint, role string, text string, path string")
    got = {r["path"].split(":")[0]: read_back(r["formatted"]) for r in format_trees(conversation_messages(df)).collect()}
    assert got["1"] == [("", "first"), ("user", "a"), ("assistant", ""), ("assistant", "b")]
    assert got["null"] == [("user", "x")] and got["2"] == [("user", "")]
    assert got["3"] == [("assistant" if k % 2 else "user", f"turn {k}") for k in range(70)]
    assert format_trees(conversation_messages(df.where("conv_id = 99"))).count() == 0
    monkeypatch.setattr(chat_tree, "MAX_ROUNDS", 3)
    ring = spark.createDataFrame([("a", "b", "user", "", 0.0), ("b", "a", "user", "", 0.0)], "id string, parent string, role string, text string, score double")
    with pytest.raises(ValueError, match="cycle"):
        format_trees(ring)


# --- quality ---

def test_sites_shrink_to_their_priors(spark):
    rows = [(k, "good" if k % 3 else "bad", "p", k, 0.9 if k % 3 else 0.2, 0.05) for k in range(90)] + [(900, "new", "q", 0, 0.5, 0.5)]
    out = {r["id"]: r for r in combine(spark.createDataFrame(rows, "id int, host string, path string, text_hash long, p_quality double, p_toxic double")).collect()}
    assert len(out) == 91
    g = out[900]["g_quality"]
    assert out[0]["host_quality"] < out[900]["host_quality"] < out[1]["host_quality"]
    assert abs(out[900]["host_quality"] - g) < abs(out[0]["host_quality"] - g)
    assert out[0]["quality"] < 0.2 and out[1]["quality"] > 0.9
    # posterior odds: own odds times the path's over the global ones
    r = out[5]
    odds = (0.9 / 0.1) * r["path_quality"] / (1 - r["path_quality"]) / (g / (1 - g))
    assert abs(r["quality"] - odds / (1 + odds)) < 1e-12


def test_judge_learns_and_keeps_rows(spark, docs, empty):
    rng = random.Random(8)
    words = [f"word{chr(97 + k)}{chr(97 + j)}" for k in range(12) for j in range(12)]
    rows, labels = [], []
    for k in range(240):
        bad, toxic = k % 4 == 0, k % 5 == 0
        w = [rng.choice(words) for _ in range(30)]
        if toxic:
            w[3] = w[9] = "horrid"
        rows.append((k, (" | " if bad else " ").join(w), "en", f"s{k % 7}"))
        labels.append((k, int(not bad), int(toxic)))
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), lab.where("doc_id < 160"), F.col("source"), F.col("lang"))
    right = {i: (q, t) for i, q, t in labels}
    seen = [(r["doc_id"], r["quality"] >= 0.5, r["toxic"] >= 0.5) for r in got.collect()]
    assert len(seen) == 240
    assert np.mean([(int(q), int(t)) == right[i] for i, q, t in seen if i >= 160]) >= 0.95
    odd = judge(docs, lab.limit(0), F.col("source"), F.col("lang")).collect()
    assert len(odd) == docs.count() and {r["p_quality"] for r in odd} == {0.5}
    assert judge(empty, lab, F.col("source"), F.col("lang")).count() == 0


# --- fingerprints ---

def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(n)) for n in (60, 120, 200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    rows = df.select("text", anchors(F.col("text")).alias("a"), F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h")).collect()
    for r in rows:
        h = r["h"]
        want = [i for i in range(len(h) - K + 1) if min(h[i], h[i + K - 1]) <= min(h[i:i + K])]
        assert [x["pos"] for x in r["a"]] == want


def test_passages_keep_their_anchors(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    df = spark.createDataFrame([(1, passage + " " + "x y " * 30), (2, "q r s t " * 20 + passage)], "doc_id int, text string")
    a = [{x["hash"]: x["pos"] for x in r[0]} for r in df.orderBy("doc_id").select(anchors(F.col("text"))).collect()]
    both = a[0].keys() & a[1].keys()
    inner = [h for h in both if a[0][h] <= 36]
    assert len(inner) >= 10 and {a[1][h] - a[0][h] for h in inner} == {80}


def test_edits(spark, docs, empty):
    rows = fingerprint_edits(docs).collect()
    assert len(rows) == docs.count()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.where("doc_id IS NOT NULL").collect()))
    want = []
    for k, (i, t) in enumerate(texts):
        q, nxt = len(t) // 4, texts[(k + 1) % len(texts)][1]
        want.append((i, len(t), hashlib.sha256((t[:len(t) - q] + nxt[:q]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows if r["doc_id"] is not None) == sorted(want)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] != "" and by[1]["near_next"] == 1.0
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == "" and by[3]["near_edited"] == 1.0
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert fingerprint_edits(empty).count() == 0
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint_documents(docs).collect()}
    assert all(prints[r["doc_id"]] == r["fingerprint"] for r in rows)


def test_edits_over_many_buckets(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10 ** 12), 300) + list(range(5, 1500))
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(30))) for i in ids]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    rows.sort()
    for k, (i, t) in enumerate(rows):
        q, nxt = len(t) // 4, rows[(k + 1) % len(rows)][1]
        assert got[i] == hashlib.sha256((t[:len(t) - q] + nxt[:q]).encode()).hexdigest()


def test_syncmers_run_without_python(spark, docs):
    plan = fingerprint_edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_language_words_held_are_bounded():
    from assay_spark.llm import lang_crf

    rng = np.random.default_rng(0)
    model = lang_crf.LanguageModel(["a", "b"], rng.normal(size=(lang_crf.FEATURES + 3, 2)), np.zeros((2, 2)), {})
    lots = [[[f"w{lot}x{i}" for i in range(40_000)]] for lot in range(8)]
    first = model.posteriors(lots[0][:1])
    for lot in lots[1:]:
        model.posteriors(lot)
    held = next(v for k, v in sys.modules["_assay_llm_worker"].values.items() if k[2] == model.key)  # what the worker holds
    assert len(held["at"]) <= 200_000 and len(held["e"]) <= 200_000
    assert np.array_equal(model.posteriors(lots[0][:1]), first)  # forgotten words are taken again

"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import base64
import collections
import hashlib
import random
import re
import textwrap
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, chat_format, exact_dedup, language_id, license_scan, mixing, near_copies, quality, simhash, substring_dedup, winnowing
from quillon.llm import queries as q
from quillon.session import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, key int, rank string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, and columns with clashing names."""
    base, long_ = words(1, 120), words(2, 9000)
    near = base.split()
    near[60] = "zzz"
    texts = [
        (1, base), (2, base), (3, " " + base.replace(" ", "  ")), (4, " ".join(near)), (5, None), (6, ""), (7, " \t\n\x0b\f\r "),
        (8, long_), (9, long_ + " tail"), (10, "one"), (11, "one two"), (12, "ONE two"), (13, "é😀 ½ ² 中文 \x1c don't"),
        (14, "aaaa" * 300), (15, words(3, 50) + " " + base[:260] + words(4, 50)), (15, words(5, 40)), (16, base), (16, base), (None, words(6, 60)),
        (17, "Licensed under the Apache License, Version 2.0.\nplain line"),
    ]
    return spark.createDataFrame(
        [(i, t, None if i == 3 else "en", None if i == 4 else f"src{(i or 0) % 3}", None, "x", 1, None) for i, t in texts], SCHEMA
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# Fingerprints

def brute_winnow(text):
    if not text:
        return []
    h = winnowing.gram_hashes(winnowing._points(text), min(winnowing.GRAM, len(text))).tolist()
    w = min(winnowing.WINDOW, len(h))
    out = []
    for i in range(len(h) - w + 1):
        at = max(j for j in range(i, i + w) if h[j] == min(h[i : i + w]))
        if not out or out[-1][1] != at:
            out.append((h[at], at))
    return out


def test_winnowing_is_the_brute_force_selection():
    for text in ("", "a", "abc" * 60, "a" * 500, words(9, 150), "é😀" * 80):
        hashes, places = winnowing.winnow(text)
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == brute_winnow(text)


def test_winnowing_finds_every_long_shared_passage():
    shared = words(10, 40)[: winnowing.WINDOW + winnowing.GRAM - 1]
    for seed in range(20):
        a, b = (winnowing.winnow(words(seed * 2 + k, 60) + shared + words(99 + k, 60))[0] for k in (0, 1))
        assert set(a.tolist()) & set(b.tolist())


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_winnowing_compares_with_the_next_document(edge, range_rows):
    rows = sorted(collected(edge), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        a, b, c = (set(h for h, _ in brute_winnow(x)) for x in (t, e, n)) if len(t) < 2000 else (None, None, None)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *((None, None) if a is None or len(n) > 2000 else (like(a, b), like(a, c)))))
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in winnowing.compare(edge, range_rows).collect()}
    for i, n, sha, x, y in want:
        r = got[i, n, sha]
        if x is not None:
            assert (r["near_edited"], r["near_next"]) == (x, y)


def test_winnowing_empty(empty):
    assert winnowing.compare(empty).count() == 0


@pytest.mark.parametrize("level", [3, 1, 4096])
def test_next_documents_over_cut_ranges(spark, monkeypatch, level):
    """Ranges cut again, with gaps, repeated and missing ids: everyone's next document is that of the sorted list."""
    monkeypatch.setattr(winnowing, "LEVEL_RANGES", level)
    r = random.Random(6)
    ids = [*r.sample(range(10**6), 60), *range(50), 7, 7, 10**9, None]
    rows = sorted(((k, f"text {i}") for i, k in enumerate(ids)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    docs = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string")
    got = sorted(((x["doc_id"], x["edited_sha256"]) for x in winnowing.compare(docs, 5).collect()), key=str)
    want = [(k, hashlib.sha256(winnowing.edited(t, rows[(i + 1) % len(rows)][1]).encode()).hexdigest()) for i, (k, t) in enumerate(rows)]
    assert got == sorted(want, key=str)


# Mixing

def test_raking_meets_all_margins():
    r = random.Random(4)
    cells = pd.DataFrame([(s, g, t, r.randint(50, 900)) for s in "abcd" for g in "xy" for t in "12"], columns=["source", "lang", "topic", "tokens"])
    goals = {"source": dict(a=0.2, b=0.3, c=0.25, d=0.25), "lang": dict(x=0.55, y=0.45), "topic": {"1": 0.4, "2": 0.6}}
    fitted = mixing.rake(cells, goals, 0.3)
    for m, goal in goals.items():
        for k, v in goal.items():
            assert abs(fitted[cells[m] == k].sum() - v) < 1e-8


def test_distributed_raking_is_the_same(spark):
    r = random.Random(5)
    local = pd.DataFrame([(s, g, t, r.randint(50, 900)) for s in "ab" for g in "xy" for t in "12"], columns=["source", "lang", "topic", "tokens"])
    goals = {"source": dict(a=0.4, b=0.6), "lang": dict(x=0.55, y=0.45), "topic": {"1": 0.4, "2": 0.6}}
    cells = spark.createDataFrame(local)
    frames = {m: spark.createDataFrame(list(g.items()), f"{m} string, goal double") for m, g in goals.items()}
    got = mixing._rake_distributed(cells, frames, 0.4, sweeps=6).toPandas().sort_values(["source", "lang", "topic"])
    assert np.allclose(got["fitted"], mixing.rake(local, goals, 0.4), atol=1e-5)


def test_mixing_topics_follow_words(spark):
    """Two vocabularies in each of two languages: topics tell the vocabularies apart, not the languages."""
    r = random.Random(3)
    pools = {(g, k): ["".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(12)] for g in ("en", "fr") for k in range(2)}
    docs = [(i, " ".join(r.choices(pools[g, i % 2], k=40)), g, "s") for i, g in enumerate(["en", "fr"] * 100 + ["fr", "en"] * 100)]
    out = mixing.weigh(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    for lang in ("en", "fr"):
        used = [{x["mix"]["topic"] for x in out if x["lang"] == lang and x["doc_id"] % 2 == k} for k in range(2)]
        assert not used[0] & used[1]


def test_mixing_query_against_brute_force(spark):
    """Cells, raking and probabilities again in plain Python from the query's own topics."""
    rows = q.op2_source_mixing(spark, SF).collect()
    texts = dict(collected(table(spark, SF, "documents")))
    cells = collections.Counter()
    for x in rows:
        assert x["tokens"] == len(texts[x["doc_id"]].split())
        cells[x["source"] or "", x["lang"] or "", x["topic"]] += x["tokens"]
    total = sum(cells.values())
    goals = []
    for side, power in enumerate((0.7, 0.7, 0.5)):
        share = collections.Counter()
        for c, n in cells.items():
            share[c[side]] += n
        goals.append({k: n**power / sum(v**power for v in share.values()) for k, n in share.items() if n})
        goals[side] = {k: v / sum(goals[side].values()) for k, v in goals[side].items()}
    fitted = {c: n / total for c, n in cells.items()}
    for _ in range(500):
        for side, goal in enumerate(goals):
            own = collections.Counter()
            for c, v in fitted.items():
                own[c[side]] += v
            fitted = {c: min(v * goal.get(c[side], 0) / own[c[side]], cells[c] / total / 0.5) if own[c[side]] else 0.0 for c, v in fitted.items()}
    for x in rows:
        c = x["source"] or "", x["lang"] or "", x["topic"]
        weight = fitted[c] * total / cells[c] if cells[c] else 1.0
        assert abs(x["weight"] - weight) < 1e-5 and abs(x["probability"] - min(weight * 0.5, 1)) < 1e-5
    drawn = sum(x["sampled"] for x in rows)
    expected = sum(x["probability"] for x in rows)
    assert abs(drawn - expected) < 4 * sum(x["probability"] * (1 - x["probability"]) for x in rows) ** 0.5 + 1


def test_mixing_reports_unmet_margins(spark):
    docs = [(i, "word " * 10, "en", "a" if i < 5 else "b", str(i % 2)) for i in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, t string")
    goals = {"source": dict(a=0.5, b=0.5), "lang": dict(en=1.0), "topic": {"0": 0.5, "1": 0.5}}
    cells, _ = mixing.cell_weights(frame, goals, "t")
    miss = mixing.margin_errors(cells, goals)
    assert 0.3 < miss["source"] < 0.5  # a has a twentieth of the tokens, and half the sample cannot come from it


def test_mixing_edges(edge, empty):
    rows = mixing.weigh(edge).select("doc_id", "h", "mix.*").collect()
    assert len(rows) == edge.count()
    assert all(0 <= r["probability"] <= 1 for r in rows)
    by_id = collections.defaultdict(set)
    for r in rows:
        if r["doc_id"] == 16:
            by_id[16].add(r["sampled"])
    assert len(by_id[16]) == 1
    assert mixing.sample(edge).columns == edge.columns
    assert mixing.weigh(empty).count() == 0


def test_mixing_sample_has_the_expected_share(spark):
    w = mixing.weigh(table(spark, "/root/testdata/sf0.01", "documents")).agg(
        F.sum(F.col("mix.tokens") * F.col("mix.probability")) / F.sum("mix.tokens"), F.sum(F.when(F.col("mix.sampled"), F.col("mix.tokens"))) / F.sum("mix.tokens")
    ).first()
    assert abs(w[0] - mixing.SAMPLE_RATE) < 0.01 and abs(w[1] - mixing.SAMPLE_RATE) < 0.08


CLASHING = ["mix", "MIX_", "identified", "row", "counts", "topic", "tokens", "host", "declared", "ll", "own_key", "kept", "node", "digest", "__topic", "__ll", "__doc_key"]


@pytest.mark.parametrize("stage", [mixing.sample, language_id.keep_identified, exact_dedup.keep_one, simhash.keep_one, near_copies.keep_one])
def test_clashing_names_pass_through(edge, stage):
    docs = edge.select("*", *[F.lit(f"mine-{c}").alias(c) for c in CLASHING])
    out = stage(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[c] == f"mine-{c}" for c in CLASHING) and r["h"] == "x"


def test_simhash_links_run_through_prints_without_id(spark):
    """Fingerprints 1, 0 and 2 of which the middle one has no doc_id."""
    prints = spark.createDataFrame([(1, 0b111), (None, 0), (2, 0b11000)], "doc_id long, fp long")
    out = simhash.near_duplicates(prints, prints=lambda rows: rows).collect()
    assert [r["component_id"] for r in out] == [1, 1, 1]


# Chat formatting

def brute_fold(events):
    """A list of open messages, changed by one event after the other."""
    stack = []
    for e in sorted(events, key=lambda e: (e["seq"], e["role"], e["text"], e["message_id"], e["kind"])):
        at = next((i for i, m in enumerate(stack) if m[0] == e["message_id"]), None)
        if at is None:
            stack.append([e["message_id"], e["role"], "" if e["kind"] == "regenerate" else e["text"]])
        elif e["kind"] == "message":
            stack[at][1:] = [e["role"], e["text"]]
        elif e["kind"] == "delta":
            stack[at][2] += e["text"]
        else:
            stack[at][2] = e["text"] if e["kind"] == "edit" else ""
            del stack[at + 1 :]
    return [(role, text) for _, role, text in stack]


EVENTS = "conv_id long, seq long, kind string, message_id string, role string, text string"


def folded(spark, events):
    got = collections.defaultdict(list)
    for x in chat_format.fold(spark.createDataFrame(events, EVENTS)).orderBy("conv_id", "position").collect():
        got[x["conv_id"]].append((x["role"], x["text"]))
    return got


def test_chat_fold_is_the_brute_force_fold(spark):
    r = random.Random(8)
    kinds = ["message", "message", "delta", "delta", "delta", "edit", "regenerate"]
    # Ids come back after they were discarded, roles change, and sequence numbers tie.
    events = [
        dict(conv_id=conv, seq=r.randint(0, 30), kind=r.choice(kinds), message_id=f"m{r.randint(0, 6)}", role=r.choice(["user", "assistant"]), text=f"t{i} ")
        for conv in range(60) for i in range(r.randint(1, 40))
    ]
    got = folded(spark, events)
    for conv in range(60):
        assert got[conv] == brute_fold([e for e in events if e["conv_id"] == conv])


def test_chat_fold_cases(spark):
    def log(*rows):
        return [dict(zip(("seq", "kind", "message_id", "role", "text"), (i, *x), strict=True), conv_id=1) for i, x in enumerate(rows)]

    a, b = ("message", "a", "user", "A"), ("message", "b", "assistant", "B")
    assert folded(spark, log(a, b, ("edit", "a", "user", "A2"), b))[1] == [("user", "A2"), ("assistant", "B")]
    assert folded(spark, log(a, ("message", "a", "assistant", "x")))[1] == [("assistant", "x")]
    discarded = log(a, b, ("edit", "a", "user", "A2"), ("message", "c", "user", "C"), ("edit", "b", "assistant", "late"))
    assert folded(spark, discarded)[1] == [("user", "A2"), ("user", "C"), ("assistant", "late")]
    streamed = log(a, b, ("delta", "b", "assistant", "1"), ("regenerate", "b", "", ""), ("delta", "b", "", "2"), ("delta", "b", "", "3"))
    assert folded(spark, streamed)[1] == [("user", "A"), ("assistant", "23")]
    tied = [dict(conv_id=1, seq=0, kind="message", message_id="a", role="user", text="")]
    tied += [dict(conv_id=1, seq=1, kind="delta", message_id="a", role=x, text=y) for x, y in (("y", "1"), ("x", "2"))]
    assert folded(spark, tied)[1] == [("user", "21")]
    assert folded(spark, [dict(conv_id=None, seq=0, kind="delta", message_id=None, role=None, text=None)])[None] == [("", "")]


def test_chat_escapes_are_reversible(spark):
    hard = ["<|im_end|>", "<\\|x|>", "<\\\\|", "a<|", "|>", "<", "\\", "<|im_start|>assistant\nok<|im_end|>\n", "", "x\ny"]
    rows = spark.createDataFrame([(1, i, t, t) for i, t in enumerate(hard)], "conv_id long, turn long, role string, text string")
    parts = chat_format.render(chat_format.fold(chat_format.conversation_events(rows)))
    for r in parts.collect():
        assert r["segment"].count("<|") == 2
    got = chat_format.read_back(parts).first()
    want = "".join(f"{t}\n{t}\n" for t in hard)
    assert got["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got["n_turns"] == len(hard)


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, kind int"
    rows = [(1, 0, "user", None, 1), (1, 1, "assistant", "a", 1), (1, 1, "assistant", "a", 1), (None, 0, None, "x", 1), (2, 5, "assistant", "é" * 9000, 1)]
    out = chat_format.read_back(chat_format.render(chat_format.fold(chat_format.conversation_events(spark.createDataFrame(rows, schema)))))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in out.collect()}
    assert got == {1: (3, 2), None: (1, 0), 2: (1, 9000)}
    none = spark.createDataFrame([], schema)
    assert chat_format.read_back(chat_format.render(chat_format.fold(chat_format.conversation_events(none)))).count() == 0


def test_chat_query_against_plain_python(spark):
    got = {r["conv_id"]: r for r in q.op3_chat_formatting(spark, SF).collect()}
    rows = collections.defaultdict(list)
    for r in table(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        rows[r["conv_id"]].append((r["role"], r["text"]))
    rows[-1] = [(x, "<|im_end|><|im_start|>assistant ok") for x in ("user", "assistant")]
    assert set(got) == set(rows)
    for k, turns in rows.items():
        said = "".join(t for x, t in turns if x == "assistant")
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{x}\n{t}\n" for x, t in turns).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


# Licences

def test_licence_families(spark, edge):
    texts = [
        "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        "All rights reserved.", "Released under the Acme Community License, version 9.", words(70, 60), None, "",
    ]
    plain = [words(200 + i, 30) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + plain)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert [got[i]["family"] for i in range(4)] == ["mit", "cc-by-nc", "gpl", "proprietary"]
    assert all(got[i]["confirmed"] for i in range(4))
    assert got[4]["family"] == "unknown" and not got[4]["confirmed"]
    assert all(got[i]["family"] == "none" for i in range(5, len(texts) + len(plain)))


def test_licences_inside_long_lines(spark):
    """A notice in the middle of prose on one line is found whatever the length of the line."""
    notices = {
        "mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "proprietary": "All rights reserved.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    }
    rows = [(f, n, f"{words(n, n // 2)} {notice} {words(n + 1, n // 2)}") for f, notice in notices.items() for n in (20, 100, 1000)]
    plain = [words(300 + i, 200) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, _, t in rows] + plain)], "doc_id long, text string")
    got = {r["doc_id"]: (r["family"], r["confirmed"]) for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [(f, True) for f, _, _ in rows]
    assert all(got[i] == ("none", False) for i in range(len(rows), len(rows) + len(plain)))


ORDINARY = {"the", "of", "and", "this", "in", "to", "a", "on", "is", "for", "with", "by", "at", "that", "are", "be", "or", "as"}


def test_licences_of_other_families_are_unknown():
    """Real wordings of licences that the templates do not have, and of families that a model was not shown."""
    foreign = [
        "Licensed under the Boost Software License, Version 1.0.", "Released under the Artistic License 2.0.", "SPDX-License-Identifier: Zlib",
        "Licensed under the European Union Public Licence", "covered by the Zebra Public License 3", "Released under the SIL Open Font License, Version 1.1.",
        "Distributed under the Microsoft Public License (Ms-PL).", "This software is distributed under the CeCILL license.",
    ]
    model = license_scan.train(ORDINARY)
    p = model.probabilities(foreign)
    assert not any(q.max() >= model.least and model.classes[q.argmax()] in license_scan.TEMPLATES for q in p)
    assert sum(q[model.classes.index("none")] < license_scan.MOST_ORDINARY for q in p) >= 7
    known = ["Eclipse Public License - v 2.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "Released under the MIT License.", "Licensed under the MPL 2.0."]
    assert [model.classes[q.argmax()] for q in model.probabilities(known)] == ["epl-2.0", "agpl", "mit", "mpl-2.0"]
    assert license_scan.train(ORDINARY, ("mit", "isc")).probabilities(["MIT License"]).shape == (1, len(license_scan.TEMPLATES))


def test_licence_query_is_the_plain_scan(spark):
    """The registered query against the same model applied in plain Python."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = license_scan.fit(docs)
    known, templates = set(model.vocabulary), license_scan._templates(model.vocabulary, [c for c in model.classes if c in license_scan.TEMPLATES])

    def judged(part):
        grams = known & set(license_scan.ngrams(part))
        if not grams.intersection(model.cues):
            return None
        p = model.probabilities([" ".join(part)])[0]
        best = model.classes[p.argmax()]
        if best == "none" or p[model.classes.index("none")] >= license_scan.MOST_ORDINARY:
            return None
        sure = p.max() >= model.least and any(license_scan._alike(grams, t, own) for f, t, own in templates if f == best)
        return not sure, -round(p.max(), 9), best if sure else "unknown"

    def of_block(block):
        """Findings (line text, family, not confirmed, -probability) of the lines of a block."""
        lines, hits, wide = block.strip("\n").split("\n"), [], license_scan.WINDOW
        tokens = [license_scan.words(x) for x in lines]
        for lo, own in enumerate(tokens):
            if not set(own).intersection(model.cues):
                continue
            starts = [0] if len(own) <= wide + license_scan.STEP else range(0, len(own) - wide + license_scan.STEP, license_scan.STEP)
            width = len(own) if len(starts) == 1 else wide
            hits += [(lo, lo, h) for at in starts if (h := judged(own[at : at + width]))]
            taken, hi = list(own), lo
            while len(taken) < wide and hi + 1 < len(tokens):
                hi += 1
                taken += tokens[hi]
            if hi > lo and len(own) < wide and (h := judged(taken[:wide])) and not h[0]:
                hits.append((lo, hi, h))
        islands, out = [], []
        for hit in sorted(hits):
            if islands and hit[0] <= max(h[1] for h in islands[-1]):
                islands[-1].append(hit)
            else:
                islands.append([hit])
        for island in islands:
            some = [h for h in island if not h[2][0]] or island
            for family in {h[2][2] for h in some}:
                lo, hi, (unsure, p, _) = min((h for h in some if h[2][2] == family), key=lambda h: (h[2][1], h[1] - h[0], h[0]))
                out.append(("\n".join(lines[lo : hi + 1]), family, unsure, p))
        return out

    want = {}
    for k, text in collected(docs):
        hits = [h for block in set(re.split(r"\n\s*\n", text)) for h in of_block(block)]
        best = min(((u, p, f) for _, f, u, p in hits), default=(True, 0, "none"))
        want[k] = (best[2], not best[0], len({h[:2] for h in hits}))
    got = {r["doc_id"]: (r["family"], r["confirmed"], r["n_paragraphs"]) for r in q.op4_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and sum(f != "none" for f, _, _ in want.values()) > 20


HEADERS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
}


def test_wrapped_licences_are_one_finding(spark):
    """Real headers wrapped at several widths, in the middle of a file, with comment signs or without."""
    rows = []
    for family, text in HEADERS.items():
        for width in (25, 40, 78):
            for sign in ("", "# ", " * "):
                body = "\n".join(sign + line for line in textwrap.wrap(text, width))
                rows.append((family, f"{words(width, 20)}\n\n{body}\n\n{words(width + 1, 20)}"))
    plain = [words(500 + i, 60) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in rows] + plain)], "doc_id long, text string")
    got = {r["doc_id"]: (r["families"], r["confirmed"]) for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [(f, True) for f, _ in rows]


def test_licences_in_one_very_long_line(spark):
    text = " ".join(HEADERS["mit"] for _ in range(3_000))  # 1.3 MB of licence words on one line
    start = time.time()
    many = "\n".join(textwrap.wrap(text, 60))  # and wrapped, without a blank line
    docs = spark.createDataFrame([(1, text), (2, words(3, 9)), (3, many)], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in license_scan.scan(docs, license_scan.train(ORDINARY)).collect()}
    assert got == {1: "mit", 2: "none", 3: "mit"} and time.time() - start < 120


def test_licence_edges(edge, empty):
    rows = license_scan.scan(edge).collect()
    assert len(rows) == edge.count()
    assert {r["doc_id"]: r["family"] for r in rows}[17] == "apache-2.0"
    assert license_scan.scan(empty).count() == 0


# Quality

def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = q.op5_quality_nbsvm(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out")
    right, n = scored.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count(F.lit(1))).first()
    assert n > 80 and right / n > 0.9


def test_quality_never_reads_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(quality.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.folded, b.folded) and (a.slope, a.offset) == (b.slope, b.offset)


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (99, 0), (8, 0), (9, 7)], "doc_id long, quality int")
    rows = quality.score(edge, quality.fit(edge, labels)).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(edge, quality.fit(edge, labels.limit(0))).filter("score <> 0.5").count() == 0
    assert quality.score(empty, quality.NEUTRAL).count() == 0


# SimHash

def brute_components(rows):
    prints = [simhash.fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    pick = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return sorted(((str(k), prints[i], str(pick[root(i)])) for i, (k, _) in enumerate(rows)))


@pytest.mark.parametrize("bucket_rows", [2, 8192])
def test_simhash_links(spark, edge, bucket_rows):
    base = words(50, 300).split()
    near = []
    for i in range(40):
        w = list(base)
        for j in range(i % 4):
            w[(i * 7 + j * 31) % 300] = f"n{i}"
        near.append((1000 + i, " ".join(w)))
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), str(r["component_id"])) for r in simhash.near_duplicates(docs, bucket_rows).collect())
    assert got == brute_components(collected(docs))


def test_simhash_links_of_close_fingerprints(spark):
    r = random.Random(3)
    center = r.getrandbits(64)
    prints = {center ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    for rows in (3, 8192):
        found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), rows).filter("a is not null").collect()
        parent = {p: p for p in signed}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in found:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
            parent[root(a)] = root(b)
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                    assert root(a) == root(b)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_simhash_keeps_one(edge, empty):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 8, 10}.issubset(ids) and 2 not in ids and None in ids
    assert simhash.near_duplicates(empty).count() == 0


# Repeated strings

def brute_repeats(texts):
    size = substring_dedup.LENGTH
    data = [t.encode() for t in texts]
    seen = collections.Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 2, np.int8)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i + 1 : i + 1 + size] = 1
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot_rows", [1, 50_000])
def test_repeated_strings(spark, edge, hot_rows):
    shared = words(60, 60)[:260]
    more = [(200 + i, words(300 + i, 30 + i) + shared[i : i + 200 + i % 5] + words(400 + i, 20)) for i in range(12)]
    more += [(300, shared * 3), (301, "ab" * 300), (302, shared[:199]), (303, words(500, 20) + "é" * 150)]
    docs = edge.filter("doc_id <> 8 and doc_id <> 9 or doc_id is null").select("doc_id", "text").unionByName(
        spark.createDataFrame(more, "doc_id long, text string")
    )
    rows = collected(docs)
    want = sorted((str(k), *x) for (k, _), x in zip(rows, brute_repeats([t for _, t in rows]), strict=True))
    got = sorted((str(r[0]), *r[1:]) for r in substring_dedup.remove_repeats(docs, hot_rows).collect())
    assert got == want


def test_repeated_strings_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


# Exact dedup

def brute_groups(rows):
    norm = [t.translate({c: None for c in (32, *range(9, 14))}) for _, t in rows]
    groups = collections.defaultdict(list)
    for (k, t), n in zip(rows, norm, strict=True):
        groups[n].append((-len(t), k is not None, k or 0, k))
    return {n: (min(g)[3], len(g)) for n, g in groups.items()}, norm


@pytest.mark.parametrize("block_chars", [7, 4096])
def test_exact_groups(edge, block_chars):
    rows = collected(edge)
    groups, norm = brute_groups(rows)
    want = sorted((str(k), str(groups[n][0]), groups[n][1], hashlib.sha256(n.encode()).hexdigest()) for (k, _), n in zip(rows, norm, strict=True))
    out = exact_dedup.exact_groups(edge, block_chars).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == want
    kept = collections.Counter(r["text_sha256"] for r in out if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_groups_with_hot_blocks(spark):
    hot = words(80, 300)
    docs = spark.createDataFrame([(i, hot) for i in range(200)] + [(1000 + i, hot + words(i, 3)) for i in range(60)], "doc_id long, text string")
    rows = collected(docs)
    groups, norm = brute_groups(rows)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs, 64).collect()}
    assert got == {k: groups[n] for (k, _), n in zip(rows, norm, strict=True)}


def test_exact_keep_one(edge, empty):
    kept = exact_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    groups, _ = brute_groups(collected(edge))
    assert kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


# BPE

@pytest.fixture(scope="module")
def library():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("batch_chars", [1, 1000, bpe.BATCH_CHARS])
def test_bpe_is_the_library(edge, library, batch_chars):
    out = bpe.decode(bpe.encode(edge, batch_chars=batch_chars)).collect()
    got = sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in out)
    assert got == sorted((str(k), library.encode_ordinary(t), t.encode()) for k, t in collected(edge))


def test_bpe_unknown_ids_fail(spark):
    for ids in ([0, 10**6], [-1]):
        with pytest.raises(Exception, match="ids that the vocabulary does not have"):
            bpe.decode(spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>")).collect()


def test_bpe_long_texts_are_cut_alike(monkeypatch, library):
    text = "don't  stop 12345 é½ \n\n" * 50
    whole = list(bpe.pretokens(text))
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    assert list(bpe.pretokens(text)) == whole and "".join(whole) == text


def test_bpe_query(spark, library):
    texts = dict(collected(table(spark, SF, "documents")))
    for r in q.op9_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_empty(empty):
    assert bpe.digests(empty).count() == 0


# Language ID

def test_language_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = language_id.identify_documents(docs)
    right, text_right, kept, n = out.agg(
        F.count_if(F.col("identified.language") == F.col("lang")), F.count_if(F.col("identified.text_language") == F.col("lang")), F.count_if("identified.accepted"), F.count(F.lit(1))
    ).first()
    assert right / n > 0.97 and text_right / n > 0.95 and kept / n > 0.99


def test_page_language(spark):
    labelled = table(spark, "/root/testdata/sf0.01", "documents").select(F.col("doc_id").alias("key"), "text", "lang")
    out = language_id.identify_pages(table(spark, "/root/testdata/sf0.01", "pages"), labelled).collect()
    assert sum(r["language"] == r["declared"] for r in out) / len(out) > 0.9
    assert {r["suffix"] for r in out} <= {"com", "net", "org"}


def test_host_prior_decides_where_text_does_not(spark):
    docs = [(i, "the that with and this there " * 5, "en", "h.en") for i in range(60)] + [(100 + i, "les des une pour dans avec " * 5, "fr", "h.fr") for i in range(60)]
    docs += [(500, "xq", None, "h.en"), (501, "xq", None, "h.fr")]
    out = language_id.identify_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    got = {r["doc_id"]: r["identified"]["language"] for r in out.collect()}
    assert (got[500], got[501]) == ("en", "fr")


def test_language_without_its_declaration(spark):
    """Trained on one half of the documents, tested on the other half without declarations."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select(F.col("doc_id").alias("key"), "text", "lang")
    models = language_id.fit(docs.filter("key % 2 = 0"))
    none = F.lit(None).cast("string")
    out = language_id.identify(docs.filter("key % 2 = 1 and length(text) >= 40"), models, "text", none, none, none)
    right, n = out.agg(F.count_if(F.col("identified.language") == F.col("lang")), F.count(F.lit(1))).first()
    assert right / n > 0.95


def test_languages_are_not_capped(spark):
    docs = [(i, f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]} " * 30, f"l{'abc'[i // 100]}{i % 100:02d}-XX", "s") for i in range(300)]
    docs = [(1000 * j + i, t, lang, s) for j in range(8) for i, t, lang, s in docs]
    out = language_id.identify_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    assert out.filter(F.col("identified.language") == F.substring_index("lang", "-", 1)).count() > 0.9 * len(docs)


def test_language_posterior_is_the_brute_force_one(spark):
    docs = [(i, words(i, 30) + " the of", "en" if i % 3 else "de", f"h{i % 2}.org") for i in range(40)]
    docs += [(100 + i, words(100 + i, 9), "xx", f"h{i % 2}.org") for i in range(2)]  # a code without a table
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    models = language_id.fit(frame.select(F.col("doc_id").alias("key"), "text", "lang"), crossed=True)
    folds = {r[0]: r[1] for r in frame.select("doc_id", language_id._fold(F.col("doc_id"))).collect()}
    names = models[0].languages
    assert names == ["de", "en", language_id.OWN, "und"]
    ll = {i: models[folds[i]].evidence(t, lang == "xx") for i, t, lang, _ in docs}
    soft = {i: np.exp(x - x.max()) / np.exp(x - x.max()).sum() for i, x in ll.items()}
    total = sum(soft.values())
    kinds = {lang for _, _, lang, _ in docs}

    def prior(k, host):
        mine = lambda host: sum(soft[i][k] for i, _, _, h in docs if host is None or h == host)
        whole = lambda host: sum(soft[i][:-1].sum() for i, _, _, h in docs if host is None or h == host)
        base = (mine(None) / whole(None) + 1e-6) * (1 - language_id.UNKNOWN_PRIOR)
        suffix = (mine(None) + 20 * base) / (whole(None) + 20)
        return np.log((mine(host) + 20 * suffix) / (whole(host) + 20))

    for r in language_id.identify_documents(frame).collect():
        told = sum(soft[i] for i, _, lang, _ in docs if lang == r["lang"])
        post = []
        for k, name in enumerate(names[:-1]):
            itself = 20 if name == r["lang"] or (name == language_id.OWN and r["lang"] == "xx") else 0
            of_class = told[k] if name == language_id.OWN else total[k]
            post.append(ll[r["doc_id"]][k] + prior(k, r["source"]) + np.log((told[k] + 1 + itself) / (of_class + len(kinds) + 20)))
        post.append(ll[r["doc_id"]][-1] + np.log(language_id.UNKNOWN_PRIOR) - np.log(len(kinds)))
        p = np.exp(np.array(post) - max(post))
        best = names[int(p.argmax())]
        assert r["identified"]["language"] == (r["lang"] if best == language_id.OWN else best)
        assert abs(r["identified"]["posterior"] - p.max() / p.sum()) < 1e-6
        assert r["identified"]["accepted"] == (best != "und" and p.max() / p.sum() >= 0.5)


FOREIGN = {
    "nl": "Het is vandaag mooi weer en de kinderen spelen buiten in de tuin terwijl hun ouders op het terras zitten en koffie drinken.",
    "sv": "Det är vackert väder idag och barnen leker ute i trädgården medan deras föräldrar sitter på terrassen och dricker kaffe.",
    "pl": "Dzisiaj jest piękna pogoda i dzieci bawią się na dworze w ogrodzie, podczas gdy ich rodzice siedzą na tarasie i piją kawę.",
    "el": "Σήμερα ο καιρός είναι όμορφος και τα παιδιά παίζουν έξω στον κήπο ενώ οι γονείς τους κάθονται στη βεράντα.",
    "ru": "Сегодня хорошая погода, и дети играют в саду, пока их родители сидят на террасе и пьют кофе с соседями.",
    "pt": "Hoje o tempo está bonito e as crianças brincam no jardim enquanto os pais tomam café com os vizinhos no terraço.",
    "th": "วันนี้อากาศดีและเด็ก ๆ เล่นอยู่ในสวนในขณะที่พ่อแม่นั่งดื่มกาแฟ",
}


@pytest.mark.parametrize("copies", [1, 5])
def test_rare_languages_are_never_taken_for_others(spark, copies):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    rare = [(10**6 + 10 * i + c, " ".join(t.split()[c:] + t.split()[:c]), lang, f"src{i}") for i, (lang, t) in enumerate(FOREIGN.items()) for c in range(copies)]
    more = spark.createDataFrame(rare, docs.schema)
    out = language_id.identify_documents(docs.unionByName(more)).filter("doc_id >= 1000000").select("lang", "identified.*").collect()
    assert len(out) == len(rare)
    for r in out:
        assert r["language"] in (r["lang"], "und") or not r["accepted"], r


def test_dirty_codes_do_not_hide_a_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("length(text) >= 60").select("doc_id", "text", "lang", "source")
    dirty = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("lang")))
    real = docs.select("doc_id", F.col("lang").alias("real"))
    out = language_id.identify_documents(dirty).filter("doc_id % 3 = 0").join(real, "doc_id")
    right, n = out.agg(F.count_if((F.col("identified.language") == F.col("real")) & F.col("identified.accepted")), F.count(F.lit(1))).first()
    assert right / n > 0.97


def test_page_language_edges(spark):
    labelled = spark.createDataFrame([], "key long, text string, lang string")
    pages = spark.createDataFrame([(1, None, None, 1), (2, "http://a.org/x", '<html lang="en"><p>the cat</p></html>', 2), (3, "", "", 3)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["language"], r["accepted"]) for r in language_id.identify_pages(pages, labelled).collect()}
    assert set(got) == {1, 2, 3} and not got[1][1] and not got[3][1]
    assert language_id.identify_pages(pages.limit(0), labelled).collect() == []


def test_language_edges(edge, empty):
    rows = {r["doc_id"]: r["identified"]["accepted"] for r in language_id.identify_documents(edge).collect()}
    assert not rows[5] and not rows[6] and not rows[7] and rows[1]
    kept = language_id.keep_identified(edge)
    assert kept.columns == edge.columns
    assert language_id.identify_documents(empty).count() == 0

"""The data-pipeline operators on small hand-made tables: brute force, odd inputs, reruns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import chat_format as chat
from fieldspark.llm import common
from fieldspark.llm import decontaminate as deco
from fieldspark.llm import embedding_dedup as emb
from fieldspark.llm import license_scan as lic
from fieldspark.llm import line_runs as runs
from fieldspark.llm import mix_sources as mixing
from fieldspark.llm import ngram_join as ngram
from fieldspark.llm import personal_data as pii
from fieldspark.llm import slot_shards as slots
from fieldspark.llm import toxicity as tox
from fieldspark.llm.catalogue import ORACLES, QUERIES
from tests.compare import compare, duck

SMALL = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def documents(spark, rows, schema="doc_id long, text string, source string, n_words string, score string, node string, size string, shard string, _copy int"):
    """Documents whose other columns clash with names that the operators use."""
    return spark.createDataFrame([(i, t, s, "n", "s", "x", "z", "h", 1) for i, t, s in rows], schema)


def prose(rng, n, words=300):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(words)}" for _ in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (3, "   \n\t", None), (None, "one two", "b"), (4, "one two", None), (4, "one two", None), (None, None, None),
       (5, "é" * 5, "b"), (6, "x " * 40_000, "b"), (7, "\x00\x01 ZÜRICH ab12", "c")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    state, _, _, info = compare(spark, duck(SMALL), name, QUERIES[name], ORACLES[name], SMALL)
    assert state == "ok", info


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


# --- 1 ---------------------------------------------------------------------------------------------------------------------------


def brute_decontamination(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = re.findall(WORD, lower(text))
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for i, text in docs:
        w = re.findall(WORD, lower(text))
        hit, named = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    named |= wins[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), ",".join(sorted(str(x) for x in named if x is not None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 300])
def test_decontaminate_against_brute_force(spark, pass_bytes):
    rng = random.Random(3)
    items = [(k, prose(rng, rng.choice([4, 9, 10, 14, 30]), 40)) for k in range(12)] + [(99, None), (98, ""), (97, "ab12 cd"), (None, "zürich ab12"), (3, "w1 w2")]
    texts = [(i, prose(rng, rng.randrange(0, 80), 40)) for i in range(30)]
    texts += [(100 + k, f"{prose(rng, 300)} {t} {prose(rng, 5)}") for k, (_, t) in enumerate(items) if t]
    rows = [(i, t, "s") for i, t in texts] + ODD
    found = deco.decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), pass_bytes=pass_bytes)
    got = found.select("doc_id", "n_words", deco.n_hit(), F.concat_ws(",", "hit_items")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_decontamination([(i, t) for i, t, _ in rows], items)
    assert "source" in found.columns and found.columns.count("n_words") == 1


def test_decontaminate_empty_tables(spark):
    docs, none = documents(spark, ODD), spark.createDataFrame([], "item_id long, text string")
    assert deco.decontaminate(docs, none).where("size(hit_spans) > 0").count() == 0
    assert deco.decontaminate(docs.limit(0), none).count() == 0
    assert deco.clean_documents(docs, none).columns == docs.columns


# --- 2 ---------------------------------------------------------------------------------------------------------------------------


def test_mix_targets_and_bounds(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + ODD
    docs = documents(spark, rows)
    keyed = common.stored(mixing.with_keys(docs), "keyed")
    plan = mixing.plan_mix(keyed)
    mixed = mixing.apply_mix(keyed, plan).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(mixed) == len(rows)
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    assert sum(r["size"] for r in mixed) == total
    by = {}
    for r in mixed:
        by.setdefault(r["source"], []).append(r)
        assert r["copies"] * r["size"] <= 2 * r["size"]
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert abs(sum(r["copies"] * r["size"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)
    # complete epochs come first
    assert all(r["copies"] >= int(r["target"] / r["source_size"]) for r in mixed if r["size"])
    again = mixing.mix(docs).groupBy("doc_id").count().collect()
    assert sorted(again, key=str) == sorted(mixing.mix(docs).groupBy("doc_id").count().collect(), key=str)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.where("text is null")).count() == 0


def test_equal_rows_are_dealt_one_by_one(spark):
    same = " ".join(["word"] * 10)
    rows = [(1, same, "a")] * 900 + [(None, same, "a")] * 100 + [(k, prose(random.Random(k), 30), "b") for k in range(10, 60)] + [(7, same, "c")] * 40
    docs = documents(spark, rows).repartition(6)
    keyed = common.stored(mixing.with_keys(docs), "keyed")
    got = mixing.apply_mix(keyed, mixing.plan_mix(keyed)).groupBy("source", "source_size", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.count("*").alias("n"), F.max("copies").alias("most")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": 1000, "b": 50, "c": 40} and all(r["most"] <= 2 for r in got)
    assert all(abs(r["taken"] - r["target"]) <= 30 for r in got)
    assert mixing.mix(docs).count() == sum(r["taken"] // 10 for r in got if r["source"] != "b") + mixing.mix(docs).where("source = 'b'").count()


def test_water_filling(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, None: 0}
    keyed = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing._targets(keyed, (3, 1, 2), 1.5, 2.0).collect()}
    # a: 3 shares, b: 1, c: 2, null: 3; a, b and null are full at twice their size
    assert got == {"a": 200.0, "b": 20.0, "c": pytest.approx(1.5 * 1110 - 220), None: 0.0}


# --- 3 ---------------------------------------------------------------------------------------------------------------------------


def brute_runs(rows, min_words):
    """Lines in any run of enough words that stands earlier, by looking at every run of every length."""
    docs = {}
    for i, t, _ in rows:
        docs.setdefault((i, t), None)
    key = lambda d: (d[0] is not None, d[0] or 0)
    places, seqs = {}, {}
    for d in docs:
        lines = [(k, x) for k, x in enumerate((d[1] or "").split("\n")) if x.strip(runs.SPACE)]
        seqs[d] = lines
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for _, x in lines]
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(n[s:e]) >= min_words:
                    places.setdefault(tuple(lower(x) for _, x in lines[s:e]), []).append((key(d), s, e, d))
    gone = {d: set() for d in docs}
    for v in places.values():
        for _, s, e, d in sorted(v, key=lambda x: x[:2])[1:]:
            gone[d] |= {k for k, _ in seqs[d][s:e]}
    return sorted(((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t, _ in rows), key=str)


def test_whole_maximal_runs_go(spark):
    """Lines of 60, 10, 10, 10 words: all four go; of two earlier copies the one that goes on longer counts."""
    rng = random.Random(6)
    run = [prose(rng, n, 10_000) for n in (60, 10, 10, 10, 8)]
    own = [prose(rng, 7, 10_000) for _ in range(9)]
    rows = [(1, "\n".join([own[0], *run[:2], own[1]]), "s"), (2, "\n".join([own[2], *run[:4], own[3]]), "s"), (3, "\n".join([own[4], *run, own[5]]), "s"), (4, "\n".join([*run[:3], own[6]]), "s")]
    got = {r["doc_id"]: r["text"] for r in runs.delete_repeated_runs(documents(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "\n".join([own[2], *run[2:4], own[3]]), 3: "\n".join([own[4], run[4], own[5]]), 4: own[6]}


def test_line_runs_against_brute_force(spark):
    rng = random.Random(8)
    pool = [prose(rng, rng.randrange(1, 12), 50) for _ in range(25)]
    block = [rng.choice(pool) for _ in range(40)]
    rows = []
    for i in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.5 else prose(rng, 5) for _ in range(rng.randrange(0, 30))]
        if i % 3 == 0:
            lines[1:1] = [x.upper() if i % 2 else x for x in block[i % 7 : 20 + i % 11]]
        if i % 5 == 0:
            lines.insert(2, "")
        rows.append((i, "\n".join(lines), "s"))
    rows += [(100, rows[3][1], "s"), (101, rows[3][1], "s"), (102, "\n".join(["same line here"] * 30), "s"), (3, rows[3][1], "s"), (None, rows[6][1], "s")]
    rows += ODD
    done = runs.delete_repeated_runs(documents(spark, rows), min_words=20)
    assert sorted((tuple(r) for r in done.select("doc_id", "text").collect()), key=str) == brute_runs(rows, 20)
    assert done.where("n_removed > 0").count() > 5
    assert runs.delete_repeated_runs(documents(spark, rows).limit(0)).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------------------


def test_license_join_is_exact(spark):
    rng = random.Random(9)
    templates = [(" ".join(rng.sample([f"w{k}" for k in range(30)], rng.randrange(2, 12))), f"l{k}") for k in range(15)]
    rows = [(i, "\n".join(prose(rng, rng.choice([3, 20, 63, 64, 65, 96, 97, 150]), 30) for _ in range(rng.randrange(0, 4))), "s") for i in range(40)] + ODD
    got = lic.scan_licenses(documents(spark, rows), templates=templates, statements=[], threshold=0.8, across_lines=False).select("doc_id", "labels", "score").collect()
    want = []
    for i, text, _ in rows:
        labels, score = set(), 0.0
        for line in lower(text).split("\n"):
            w = re.findall(WORD, line)
            for s in range(0, max(len(w) - lic.STEP, 1), lic.STEP) if w else ():
                block = set(w[s : s + lic.BLOCK])
                for t, label in templates:
                    share = len(block & set(t.split())) / len(set(t.split()))
                    if len(block & set(t.split())) >= math.ceil(0.8 * len(set(t.split())) - 1e-9):
                        labels.add(label)
                        score = max(score, share)
        want.append((i, ",".join(sorted(labels)), score))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_license_phrases(spark):
    docs = documents(spark, [(51, "The MIT\nLicense, CC-BY 4.0; mit license", "s"), (52, "mit licenses", "s"), *ODD])
    got = {r["doc_id"]: r for r in lic.scan_licenses(docs).where("doc_id > 50").collect()}
    assert (got[51]["n_base"], got[51]["first_word"], got[51]["last_word"], got[51]["base_labels"]) == (3, 1, 7, "cc-by,mit")
    assert (got[52]["n_base"], got[52]["first_word"], got[52]["labels"]) == (0, None, "")
    assert lic.scan_licenses(docs.limit(0)).count() == 0


def header(text, mark="# ", width=9):
    """A paragraph as a commented, hard-wrapped header."""
    w = text.split()
    return "\n".join(mark + " ".join(w[k : k + width]) for k in range(0, len(w), width))


def test_headers_have_their_own_label_only(spark):
    lead = "\n".join(f"line{k} of code" for k in range(70))
    rows = [(k, f"{lead}\n{header(text)}\n{lead}", label) for k, (text, label, _) in enumerate(lic.PARAGRAPHS)]
    # some words of a header changed or left out
    rows += [(100 + k, header(" ".join(x for i, x in enumerate(text.split()) if i % 25 != 7)), label) for k, (text, label, _) in enumerate(lic.PARAGRAPHS[:7])]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in lic.scan_licenses(documents(spark, rows)).collect()}
    for k, _, label in rows:
        assert label in got[k][0].split(",") and got[k][1] >= 0.9, (k, label, got[k])
        extra = set(got[k][0].split(",")) - {label}
        assert not extra, (label, extra)


def test_prose_is_no_license(spark):
    texts = [
        "all the people have their rights and a table was reserved", "the mit people released the film under the license",
        "a general license for the public of gnu", "permission to copy this software is not granted to any person free of charge",
        "works under cc and by 4 0 licensed", "the binary source and forms are permitted with modification or without redistribution and use",
    ]
    got = lic.scan_licenses(documents(spark, [(k, t, "s") for k, t in enumerate(texts)])).select("labels", "score").distinct().collect()
    assert [tuple(r) for r in got] == [("", 0.0)]


def test_license_scan_of_odd_texts(spark):
    for across in (True, False):
        got = lic.scan_licenses(documents(spark, ODD), across_lines=across).collect()
        assert len(got) == len(ODD) and {(r["labels"], r["score"], r["n_base"]) for r in got} == {("", 0.0, 0)}
    assert lic.scan_licenses(documents(spark, ODD).limit(0)).count() == 0


def test_wrapped_and_long_licenses(spark, tmp_path):
    bsd = " * Redistribution and use in source and binary forms, with or\n * without modification, are permitted"
    isc = "# Permission to use, copy, modify, and/or distribute\n# this software for any purpose with or\n# without fee is hereby granted"
    mpl = "This Source Code Form is subject\nto the terms of the Mozilla Public\nLicense, v. 2.0."
    lead = "\n".join(f"line{k} of code" for k in range(40))
    rows = [(k, f"{lead}\n{t}\n{lead}", "s") for k, t in enumerate([bsd, isc, mpl, "nothing here"])]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in lic.op4_license_scan(spark, str(tmp_path)).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("isc", 1.0), 2: ("mpl", 1.0), 3: ("", 0.0)}
    whole = " ".join(f"t{k}" for k in range(300))  # a whole license text
    docs = documents(spark, [(k, f"{'a ' * k}{whole}", "s") for k in (0, 7, 299)] + [(1, whole[:800], "s")])
    long = lic.scan_licenses(docs, templates=[(whole, "long")]).select("doc_id", "labels").collect()
    assert sorted(map(tuple, long)) == [(0, "long"), (1, ""), (7, "long"), (299, "long")]


# --- 5 ---------------------------------------------------------------------------------------------------------------------------


def plain_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_exact_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("a1 .@-+0_(é7") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain_base(t), t
    for t in ["9" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "1." * 50_000, "1 " * 50_000]:
        pii.base_spans(t)  # linear


def test_field_held_out_accuracy():
    field, rng = pii.train(), random.Random(77)
    hit = miss = extra = 0
    for _ in range(150):
        text, gold = pii.sentence(rng)
        found = set(pii.all_spans(text, field)[1])
        hit, miss, extra = hit + len(found & gold), miss + len(gold - found), extra + len(found - gold)
    assert hit / (hit + miss) > 0.85 and hit / (hit + extra) > 0.9


def test_dynamic_program_finds_the_best_segmentation():
    field = pii.train()
    for text in ["call 212-555-0188 x", "a 10.0.0.1 b", "me@ab.org", "no 12 at 5"]:
        tokens = next(pii.windows(text))[:9]
        segments = list(pii.candidate_segments(text, tokens, field.names))
        scores, outside = field.scores(segments), field.outside_scores(text, tokens)

        def every(at, tokens=tokens, segments=segments):
            if at == len(tokens):
                yield 0.0
                return
            for rest in every(at + 1):
                yield outside[at] + rest
            for k, (i, j, _) in enumerate(segments):
                if i == at:
                    for rest in every(j):
                        yield scores[k].max() + rest

        best = field.best(text, tokens)
        covered = [any(s <= a and b <= e for s, _, e in best) for a, b in tokens]
        value = sum(o for o, c in zip(outside, covered, strict=True) if not c)
        ends = {(tokens[i][0], tokens[j - 1][1]): k for k, (i, j, _) in enumerate(segments)}
        value += sum(scores[ends[s, e], kind] for s, kind, e in best)
        assert value == pytest.approx(max(every(0)))


def test_personal_data_rows(spark):
    docs = documents(spark, [(1, "ü mail a.b@c.de and (212) 555-0188", "s"), *ODD])
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == len(ODD) + 1
    one = next(r for r in rows if r["doc_id"] == 1)
    assert [tuple(s) for s in one["base_spans"]] == [("email", 7, 15)]
    assert ("phone", 20, 34) in [tuple(s) for s in one["all_spans"]]
    assert all(not r["all_spans"] for r in rows if r["doc_id"] in (2, 5))
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_spelled_addresses_without_digits(spark):
    spelled = ["john at example dot com", "john.doe [at] example [dot] com", "john.doe [at] example [dot] co [dot] uk",
               "anna (at) " + "longname" * 9 + " (dot) mail (dot) org"]
    texts = [f"please write to {s} soon" for s in spelled] + ["we met at noon and sat at home", "a flat matter"]
    rows = pii.find_personal_data(documents(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()
    got = {r["doc_id"]: [tuple(s) for s in r["all_spans"]] for r in rows}
    assert got == {k: [("email", 16, 16 + len(s))] for k, s in enumerate(spelled)} | {4: [], 5: []}
    for t in ["a" * 50_000 + " at ", "00" + "1 " * 20_000, "x at y " * 3_000]:
        pii.LONG.findall(t)  # linear


# --- 6 ---------------------------------------------------------------------------------------------------------------------------


def brute_groups(rows):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    smallest = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(smallest.get(find(k), i), i)
    return sorted(((i, len(sets[k]), smallest.get(find(k)) if sets[k] else i) for k, (i, _, _) in enumerate(rows)), key=str)


def near_copies(rng):
    rows = []
    for base in range(6):
        words = prose(rng, rng.choice([7, 12, 30, 90, 200]), 400).split()
        for _ in range(rng.randrange(1, 14)):
            own = list(words)
            for _ in range(rng.randrange(0, max(1, len(own) // 25 + 2))):
                own[rng.randrange(len(own))] = f"own{rng.randrange(10**6)}"
            rows.append((len(rows) + 10, " ".join(own), "s"))
    passage = prose(rng, 40, 400)
    rows += [(500 + k, f"{passage} {prose(rng, rng.choice([3, 8, 20, 60]))}", "s") for k in range(30)]
    return rows + [(900 - k, rows[k][1].upper(), "s") for k in range(6)] + [(950 + k, "a b c d", "s") for k in range(3)]


@pytest.mark.parametrize("frequent,part", [(64, 1024), (2, 3)])
def test_jaccard_groups_against_brute_force(spark, monkeypatch, frequent, part):
    monkeypatch.setattr(ngram, "FREQUENT", frequent)
    monkeypatch.setattr(ngram, "PART", part)
    rows = near_copies(random.Random(21 + frequent)) + ODD
    got = ngram.jaccard_groups(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_groups(rows)


def test_jaccard_empty_and_kept(spark):
    docs = documents(spark, [(3, "a b c d e f g", "s"), (2, "A b c d e f g", "s"), (1, "other", "s"), (None, "a b c d e f g", "s"), (9, None, "s")])
    assert ngram.jaccard_groups(docs.limit(0)).count() == 0
    kept = ngram.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 9]


def test_one_row_of_each_group_stays(spark):
    near = prose(random.Random(3), 60)
    rows = [(1, "a b c d e f", "s")] * 40 + [(2, "A b c d e f", "s")] * 3  # repeated rows, and a copy of them
    rows += [(None, "g h i j k l", "s")] * 20 + [(None, "g h i j k L", "t")]  # only rows without an id
    rows += [(3, near, "s"), (4, near + " end", "s"), (4, "text of its own, no copy", "s"), (4, near, "t")]  # one id with several texts
    rows += [(None, near, "s"), (None, near, "s")]  # copies of one with an id
    rows += [(7, "once", "s"), (7, "once", "t"), (8, None, "s"), (8, None, "s"), (None, "", "s"), (None, "", "s")]
    kept = ngram.first_of_groups(documents(spark, rows)).collect()
    got = sorted(((r["doc_id"], lower(r["text"])) for r in kept), key=str)
    want = [(1, "a b c d e f"), (None, "g h i j k l"), (3, near), (4, "text of its own, no copy"), (7, "once")]
    assert got == sorted([*want, (8, ""), (8, ""), (None, ""), (None, "")], key=str)


@pytest.mark.parametrize("frequent", [512, 2])
def test_one_row_of_each_group_comes_from_short_queries(spark, monkeypatch, frequent):
    """The driver holds the plan and the tasks of a query until it ends: no step may be one query of dozens of exchanges."""
    exchanges = {}

    def counted(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges[name] = max(exchanges.get(name, 0), len(re.findall("Exchange ", plan)))
        return common.stored(df, name)

    monkeypatch.setattr(ngram, "FREQUENT", frequent)
    monkeypatch.setattr(ngram, "stored", counted)
    rows = near_copies(random.Random(5))
    kept = ngram.first_of_groups(documents(spark, rows)).collect()
    assert {r["doc_id"] for r in kept} == {c for _, _, c in brute_groups(rows)}
    assert max(exchanges.values()) <= 20, exchanges


def test_shown_shingles_are_counted_in_turns(spark, monkeypatch):
    """Of the shuffle of all shown shingles, the largest, only a part is on disk beside them, and both are gone before the next one."""
    steps = []

    def noted(df, name):
        steps.append(name)
        return common.stored(df, name)

    monkeypatch.setattr(ngram, "stored", noted)
    monkeypatch.setattr(ngram, "free_shuffles", lambda session: steps.append("free"))
    monkeypatch.setattr(ngram, "discard", lambda *tables: steps.extend(t._scratch.rsplit("/", 1)[1].split("-")[0] for t in tables))
    rows = near_copies(random.Random(6)) + ODD
    got = ngram.jaccard_groups(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_groups(rows)
    assert steps[: steps.index("possible")] == ["shown", "rows", *["common", "free"] * ngram.TURNS, "shown"] and ngram.TURNS > 1


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, common.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randrange(10, 60)).split()
        bad = i % 6 == 0
        for _ in range(rng.randrange(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "loser", "vequmo", "vequx", "vequille", "trash"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (3, None, None), (3, 0, 0)]
    docs = documents(spark, rows + [(1000 + k, t, s) for k, (_, t, s) in enumerate(ODD)])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in tox.score_toxicity(docs, table).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(got[i]["predicted"] == (i % 6 == 0) for i in held)
    assert right / len(held) > 0.95
    assert all(0 <= got[1000 + k]["score"] < 0.7 for k in range(len(ODD)))
    assert tox.clean_documents(docs, table).columns == docs.columns
    # labels that may not be learned from change nothing
    flipped = spark.createDataFrame([(i, q, 1 - y if i in held else y) for i, q, y in labels[:900]], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs, flipped).collect()} == {i: r["score"] for i, r in got.items()}


def test_toxicity_without_labels(spark):
    docs, none = documents(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in tox.score_toxicity(docs, none).collect()} == {0.0}
    assert tox.score_toxicity(docs.limit(0), none).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(40_000) < 0.1
    rates = np.array([0.8, 0.7, 0.6, 0.5, 0.05])
    noise = np.array([0.01, 0.02, 0.01, 0.05, 0.05])
    votes = np.where(y[:, None], rng.random((len(y), 5)) < rates, rng.random((len(y), 5)) < noise)
    votes = np.concatenate([votes, votes[:, :1]], 1)  # a copy of the first voter
    counts = np.bincount(votes @ (1 << np.arange(6)), minlength=64).astype(float)
    model = tox.fit_label_model(counts, 6, 0.1)
    assert (0, 5) in model.pairs
    assert model.accuracy[1] > model.accuracy[3] > model.accuracy[4]
    assert ((model.posterior(votes.astype(float)) > 0.5) == y).mean() > 0.97


# --- 8 ---------------------------------------------------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 24))
    rows = []
    for k in range(700):
        v = base[k % 60] + rng.standard_normal(24) * (0.12 if k % 4 else 0.5)
        rows.append((k, [float(np.float32(x)) for x in v], k % 3 if k % 11 else 0))
    rows += [(800 + k, rows[5][1], rows[5][2]) for k in range(40)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] * 24, 1), (904, rows[5][1], None), (905, [1.0, None], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, point string")
    got = {r["vec_id"]: r for r in emb.near_duplicates(table, leaf=32).collect()}
    assert len(got) == len(rows)
    links = {r[0]: 0 for r in rows}
    ok = [r for r in rows if r[1] and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1]) and r[2] is not None]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ok, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1]), np.array(b[1])
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a[0]] += 1
                links[b[0]] += 1
                p, q = find(a[0]), find(b[0])
                parent[max(p, q)] = min(p, q)
    found, true = sum(r["n_links"] for r in got.values()), sum(links.values())
    assert true > 2000 and 0.9 * true <= found <= true
    assert all(r["n_links"] <= links[i] for i, r in got.items())
    assert got[906]["component_id"] == 906 and got[907]["component_id"] == 906
    for i in (900, 901, 902, 903, 904, 905):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    same = sum(got[i]["component_id"] == find(i) for i in got)
    assert same >= 0.97 * len(got)
    assert emb.near_duplicates(table.limit(0)).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------------------------


def test_shards_balance_with_hot_rows(spark):
    rows = [(i, "t" * (i % 97), "s") for i in range(3000)] + [(77, "same text", "s")] * 1500 + ODD
    docs = documents(spark, rows)
    out = slots.shard_documents(docs, 8).cache()
    assert out.count() == len(rows) and out.columns == [*[c for c in docs.columns if c != "shard"], "shard"]
    sizes = [r[0] for r in out.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).select(F.col("sum((coalesce(octet_length(text), 0) + 8))")).collect()]
    mean = (sum(sizes) - 80_000) / 8
    assert sorted(sizes)[-2] - sorted(sizes)[0] < 0.2 * mean  # one shard holds the one long text
    assert slots.shard_documents(docs.limit(0), 8).count() == 0


def test_rebalance_moves_little(spark, tmp_path):
    rng = random.Random(1)
    loads = {s: rng.randrange(50, 150) for s in range(512)}
    first = slots.rebalance(slots.first_map(8, 512), loads, 8)
    grown = slots.rebalance(first, loads, 9)
    assert sorted(grown) == list(range(512)) and set(grown.values()) == set(range(9))
    moved = sum(first[s] != grown[s] for s in first)
    assert moved <= 512 / 9 * 1.3
    per = [sum(loads[s] for s in grown if grown[s] == k) for k in range(9)]
    assert max(per) - min(per) < 0.02 * sum(per) / 9
    slots.store_map(spark, str(tmp_path), 1, first)
    slots.store_map(spark, str(tmp_path), 2, grown)
    assert {r["slot"]: r["shard"] for r in slots.load_map(spark, str(tmp_path), 1).collect()} == first
    with pytest.raises(Exception, match="exists"):
        slots.store_map(spark, str(tmp_path), 2, grown)


def test_later_runs_edit_the_stored_map(spark, tmp_path):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 80)) for _ in range(3000)]
    records = lambda n: slots.measured(spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string"))
    path = f"{tmp_path}/map"
    owner = lambda v: {r["slot"]: r["shard"] for r in slots.load_map(spark, path, v).collect()}
    slots.plan_shards(records(2850), 24, path=path)
    assert slots.newest_version(spark, path) == 2
    slots.plan_shards(records(2850), 24, path=path)
    assert slots.newest_version(spark, path) == 2  # nothing to edit
    _, now = slots.plan_shards(records(3000), 24, path=path)  # 5 % more rows
    assert slots.newest_version(spark, path) == 3
    two, three = owner(2), owner(3)
    moved = sum(two[s] != k for s, k in three.items())
    assert 0 < moved < 0.15 * slots.SLOTS
    loads = slots.slot_loads(slots.with_slots(records(3000), slots.heavy_rows(records(3000))))
    shard = {k: sum(loads.get(s, 0) for s, o in three.items() if o == k) for k in range(24)}
    assert max(shard.values()) - min(shard.values()) <= max(0.01 * sum(shard.values()) / 24, max(loads.values()))
    slots.plan_shards(records(3000), 25, path=path)
    four = owner(4)
    assert sum(four[s] != k for s, k in three.items()) < 0.15 * slots.SLOTS and 24 in four.values()
    out = slots.shard_documents(records(3000).select("doc_id", "text"), 25, path)
    assert out.count() == 3000 and slots.newest_version(spark, path) == 4


def test_registered_shards_follow_their_law(spark, tmp_path):
    """Nulls, repeated rows and a hot row: gapless slots, equal texts alike, near equal bytes."""
    rng = random.Random(4)
    rows = [(i if i % 11 else None, prose(rng, rng.randrange(0, 50)), "s") for i in range(4000)] + [(5, "same text " * 20, "s")] * 2000 + ODD[:5]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = slots.op9_slot_shards(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(24))
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 24


def test_shard_query(spark):
    rows = QUERIES["op9_slot_shards"](spark, SMALL).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(24))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 for r in rows)


# --- 10 --------------------------------------------------------------------------------------------------------------------------


def test_chats_round_trip(spark):
    rng = random.Random(12)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|turn|>", "<", "|", "\\", "\n", "ok", "<|turn|>", "assistant", "%0A", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a%\n<b"]), "".join(rng.choice(bits) for _ in range(rng.randrange(6)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(70, 0, None, None), (70, None, "user", "x"), (71, 0, "assistant", None), (71, 0, "assistant", "y"), (71, 0, "assistant", "y"), (None, 0, "user", "z")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, blocks string")
    formatted = chat.format_chats(table).cache()
    got = {r["conv_id"]: r for r in chat.read_chats(formatted.drop("blocks")).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    assert all(got[c]["loss_text"] == "".join(t for role, t in v if role == "assistant") for c, v in want.items())
    assert all(r["formatted"].count("<|im_start|>") == len(r["blocks"]) for r in formatted.collect())
    assert chat.format_chats(table.limit(0)).count() == 0


def test_chat_plan_is_native(spark):
    plan = QUERIES["op10_chat_format"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- pipeline --------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontaminate", "mix_sources", "slot_shards"]
    now, seen = docs, []
    for name, stage in pipeline.STAGES:
        now = common.stored(stage(spark, now, SMALL), f"test-{name}")
        seen.append(now)
        assert now.columns == docs.columns + (["shard"] if name == "slot_shards" else [])
    near, clean = seen[1], seen[2]
    marked = spark.read.parquet(f"{SMALL}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = docs.select("doc_id").join(marked, "doc_id").join(seen[0].select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").collect()
    toxic, plain = [r["kept"] for r in marked if r["toxic"]], [r["kept"] for r in marked if not r["toxic"]]
    # six toxic rows to learn from
    assert toxic.count(None) >= 0.5 * len(toxic) and plain.count(None) <= 0.05 * len(plain)
    rows = [(r["doc_id"], r["text"], "s") for r in seen[0].collect()]
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({c for _, _, c in brute_groups(rows)})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = {r[0] for r in brute_decontamination([(r["doc_id"], r["text"]) for r in near.collect()], items) if r[2]}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - hits
    words = lambda df: df.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"([^ \t-\r]+)"), F.lit(1))))).first()[0]
    assert words(seen[3]) == pytest.approx(1.5 * words(clean), rel=0.1)
    assert seen[4].count() == seen[3].count()


def test_word_helpers():
    from fieldspark.llm.words import ALNUM, NONSPACE, split_words

    texts = ["Ab cd", None, "", "é1_x", "a\x00b", " end", "no"]
    for inside, rule in ((ALNUM, WORD), (NONSPACE, r"[^\x20\x09-\x0D]+")):
        w = split_words(pa.array(texts, pa.string()).slice(1), inside)
        got = [[w.word(i) for i in range(w.row_at[r], w.row_at[r + 1])] for r in range(len(texts) - 1)]
        assert got == [re.findall(rule, lower(t)) for t in texts[1:]]
    anagrams = split_words(pa.array(["abc acb bac cab ab ba"]), ALNUM).hashes()
    assert len(set(anagrams.tolist())) == 6
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")

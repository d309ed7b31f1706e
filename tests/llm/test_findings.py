"""Toxicity, secrets and benchmark passages: brute force, planted cases, held-out accuracy."""

from __future__ import annotations

import random
import zlib

import pyarrow.parquet as pq
from helpers import clashing, rows_of, table, words

from shelfcast.llm import decontaminate, queries, secrets, toxicity
from shelfcast.llm.storage import read

BAD = ["blorgon", "snarvik", "dreckel", "fumpish"]


def test_maximal_segments_against_all_segments():
    draw = random.Random(5)
    for _ in range(200):
        scores = [draw.choice([-3, -2, -1, 1, 2, 3]) for _ in range(draw.randrange(1, 14))]
        found = toxicity.maximal_segments(scores)
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        best = max(sums.values())
        if best <= 0:
            assert found == []
            continue
        assert max(s for _, _, s in found) == best
        assert all(sums[a, b] == s and s > 0 for a, b, s in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
        # every part of a segment that starts or ends it has a positive sum
        for a, b, _ in found:
            assert all(sums[a, i] > 0 and sums[i, b] > 0 for i in range(a + 1, b))
        assert {i for i, s in enumerate(scores) if s > 0} == {
            i for i, s in enumerate(scores) if s > 0 and any(a <= i < b for a, b, _ in found)
        }


def toxic_table(n=400):
    draw, rows, labels = random.Random(6), [], []
    for i in range(n):
        text = words(draw.randrange(20, 120), 1000 + i).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(BAD).upper() + "!")
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxic_texts_are_found_and_clean_ones_left(spark):
    rows, labels = toxic_table()
    rows += [(9000, None), (9001, ""), (None, "blorgon snarvik"), (9002, "1 2 3")]
    labels += [(9000, 1), (None, 1)]
    docs, marks = clashing(table(spark, rows)), table(spark, labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for d, y in labels[:400]:
        assert found[d].predicted == y, d
        assert found[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
    assert found[0].passages and not found[1].passages
    assert found[9000].score == found[9001].score == found[9002].score < 0.5 and found[None].held_out is False
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows if found[d].predicted == 0}


def test_held_out_labels_change_nothing(spark):
    rows, labels = toxic_table(150)
    turned = [(d, 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, y in labels]
    docs = table(spark, rows)
    scores = [
        rows_of(toxicity.score(docs, toxicity.fit(docs, table(spark, x, "doc_id long, toxic int"))).select("doc_id", "score"))
        for x in (labels, turned)
    ]
    assert scores[0] == scores[1]


def held_out_results(spark, rows, labels, more=(), more_labels=()):
    """(recall, share of clean ones left alone) over the first rows that aren't learned from."""
    docs = table(spark, rows)
    model = toxicity.fit(
        table(spark, [*rows, *more]), table(spark, [*labels, *more_labels], "doc_id long, toxic int")
    )
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    mine = [(y, found[d].predicted) for d, y in labels if found[d].held_out]
    bad, good = [p for y, p in mine if y], [p for y, p in mine if not y]
    return sum(bad) / len(bad), 1 - sum(good) / len(good)


def near_copies(n, seed=1):
    base = words(200, seed).split()
    out = []
    for i in range(n):
        text = list(base)
        text[i % len(text)] = f"edit{i}"
        out.append((100_000 + i, " ".join(text)))
    return out


def test_near_copies_of_one_text_do_not_change_what_is_learned(spark):
    rows, labels = toxic_table()
    for n, label in ((3000, 0), (300, 1)):
        copies = near_copies(n)
        recall, left = held_out_results(spark, rows, labels, copies, [(d, label) for d, _ in copies])
        assert recall >= 0.9 and left >= 0.98, (label, recall, left)


def test_near_copies_share_the_weight_of_one_text(spark):
    rows = [(d, t, 0) for d, t in near_copies(200)] + [(i, words(150, 50 + i), 1) for i in range(50)]
    rows += [(900 + i, "", 0) for i in range(4)] + [(950, "only three words", 0)]
    weights = {
        r.id: r.weight / toxicity.WHOLE
        for r in toxicity.weighted(table(spark, rows, "id long, text string, toxic int")).collect()
    }
    assert sum(weights[d] for d, _ in near_copies(200)) < 3
    assert all(weights[i] == 1 for i in range(50)) and weights[950] == 1 and weights[900] == 0.25


def test_longer_toxic_texts_do_not_make_common_words_toxic(spark):
    draw, rows, labels = random.Random(16), [], []
    for i in range(3000):
        bad = i % 9 == 0
        text = [f"w{int(draw.paretovariate(0.7)) % 500}" for _ in range(draw.randrange(30, 70) + 20 * bad)]
        if bad:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(BAD))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    recall, left = held_out_results(spark, rows, labels)
    assert recall >= 0.95 and left >= 0.99, (recall, left)


def test_scores_by_brute_force(spark):
    import math
    import re

    rows, labels = toxic_table()
    rows += [(5000, words(30_000, 77) + " blorgon snarvik dreckel " + words(20_000, 78))]
    docs = table(spark, rows)
    model = toxicity.fit(docs, table(spark, labels, "doc_id long, toxic int"))
    vocabulary = sorted({w for _, t in rows for w in re.findall(r"[^\W\d_]+", t.lower())})
    import pyarrow as pa

    hashes = next(toxicity._words(pa.array([" ".join(vocabulary)])))[2]
    own = dict(zip(model.tokens.tolist(), model.scores.tolist(), strict=True))
    odds = {w: own.get(h, model.other) for w, h in zip(vocabulary, hashes.tolist(), strict=True)}

    def expected(text):
        tokens = re.findall(r"[^\W\d_]+", text.lower())
        surprise = 0.0
        for _, _, s in toxicity.maximal_segments([odds[w] for w in tokens]):
            chance = max(model.scale * len(tokens) * math.exp(-model.decay * s), 1e-300)
            surprise -= math.log(chance) if chance <= toxicity.SIGNIFICANT else 0.0
        return 1 / (1 + math.exp(-(model.intercept + model.slope * min(surprise, 40.0))))

    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - expected(dict(rows)[r.doc_id])) < 1e-9, r.doc_id
        assert r.predicted == (r.score >= 0.7)


def test_a_model_without_a_tell_says_so():
    import numpy as np
    import pytest

    with pytest.warns(UserWarning):
        intercept, slope = toxicity._platt(np.array([0.0, 5.0]), np.array([50.0, 1.0]), np.array([50.0, 60.0]))
    assert slope == 0 and abs(intercept - toxicity._log_odds(51, 110)) < 1e-12


def test_toxicity_without_labels_or_rows(spark):
    none = table(spark, [], "doc_id long, toxic int")
    docs = table(spark, [(1, "a b"), (2, None)])
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    empty = table(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.queries()["op5_toxicity"](spark, sf_dir).collect()}
    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()
    mine = [(r["toxic"], found[r["doc_id"]].predicted) for r in labels if found[r["doc_id"]].held_out]
    right = sum(y == p for y, p in mine) / len(mine)
    assert right > 0.93 and sum(p for y, p in mine if not y) <= 1


ITEM = "A farmer named Alice Brown has 12 apples and gives 5 apples to Bob before walking 3 km home with the rest of them"


def item_rows():
    other = ITEM.replace("Alice", "Carla").replace("Bob", "Denis").replace("12", "48").replace("5", "7").replace("3 km", "9 miles")
    torn = "We saw Alice and had 12 apples. Then we gave 5 apples to Bob."
    mixed = ITEM.replace("12 apples and gives 5 apples", "12 apples and gives 12 apples")
    return [
        (1, words(40, 1) + " " + ITEM + " " + words(30, 2)), (2, words(30, 3) + " x " + other), (3, torn), (4, words(200, 4)),
        (5, None), (6, ""), (7, words(20, 5) + " " + mixed), (None, ITEM), (8, "12 13 14 " * 40), (1, ITEM), (9, ITEM.upper()),
    ]


def test_passages_are_found_with_other_numbers_and_names(spark):
    bench = table(spark, [(100, ITEM), (101, None), (102, ""), (103, "too short"), (104, words(20, 4))], "item_id long, text string")
    found = rows_of(decontaminate.leaked_passages(clashing(table(spark, item_rows())), bench).select("doc_id", "item_id"))
    assert (1, 100) in found and (2, 100) in found and (4, 104) in found
    # 5 and 12 became one number: no exchange of values explains the text
    assert {d for d, _ in found} <= {1, 2, 4, 9}


def test_verbatim_passages_are_found_whatever_they_hold(spark):
    short = "Carla bought 7 red lamps from an old shop beside the quiet harbour"
    dense = "Compute 12 + 34 * 56 - 78 + 90 and 11 + 13 * 17 - 19"
    shown = "Seven boats 21 22 23 24 cross the cold bay in a storm tonight"
    long = f"first {words(25, 61)} 40 {words(14, 62)} 40 {words(18, 63)}"
    twisted = " 41 ".join(long.rsplit(" 40 ", 1))
    bench = table(spark, [(1, short), (2, dense), (3, long), (4, shown)], "item_id long, text string")
    rows = [
        (10, f"{words(20, 64)} {short} {words(9, 65)}"), (20, f"{words(20, 66)} {dense} {words(9, 67)}"),
        (30, f"{words(20, 68)} {twisted} {words(9, 69)}"), (40, f"{words(20, 70)} {shown} {words(9, 71)}"),
        (11, f"{words(20, 72)} {short.replace('Carla', 'Denis').replace('7', '8')} {words(9, 73)}"), (50, words(80, 74)),
    ]
    found = rows_of(decontaminate.leaked_passages(table(spark, rows), bench).select("doc_id", "item_id"))
    assert found == [(10, 1), (11, 1), (20, 2), (30, 3), (40, 4)]


def test_no_passages_in_nothing(spark):
    bench = table(spark, [(100, ITEM)], "item_id long, text string")
    assert decontaminate.leaked_passages(table(spark, []), bench).count() == 0
    assert decontaminate.leaked_passages(table(spark, item_rows()), table(spark, [], "item_id long, text string")).count() == 0


def test_large_benchmarks_are_joined_without_the_lookup(spark, monkeypatch):
    bench = table(spark, [(100, ITEM)], "item_id long, text string")
    docs = table(spark, item_rows())
    with_lookup = rows_of(decontaminate.leaked_passages(docs, bench))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert rows_of(decontaminate.leaked_passages(docs, bench)) == with_lookup


def test_whole_passages_of_the_tables_are_found(spark, sf_dir):
    """Brute force: items whose words stand in a document side by side."""
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    found = {(r.doc_id, r.item_id) for r in queries.queries()["op9_decontamination"](spark, sf_dir).collect()}
    plain = lambda s: " " + " ".join((s or "").split()) + " "
    expected = {(d["doc_id"], i["item_id"]) for d in docs for i in items if plain(i["text"]) in plain(d["text"])}
    assert expected <= found and len(found) <= len(expected) + 2


def secret_rows():
    draw, rows = random.Random(7), []
    for i in range(120):
        key = "".join(draw.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f'{words(20, i)} token = "{key}" {words(5, 500 + i)}' if i % 2 else f"{words(20, i)} {draw.randrange(10**15, 10**16)} mail.{i}@example-server.com"))
    return rows + [(500, None), (501, ""), (None, "password=7a8b9c0d1e2f3a4b5c"), (502, "w" * 9000), (503, "=" * 40 + " ::::")]


def test_secrets_are_kept_and_look_alikes_removed(spark):
    found = secrets.scan(clashing(table(spark, secret_rows()))).collect()
    kept = {r.doc_id for r in found if r.is_secret}
    assert kept == {i for i in range(120) if i % 2} | {None}
    assert {r.doc_id for r in found} >= set(range(120))


def test_no_secrets_in_nothing(spark):
    assert secrets.scan(table(spark, [])).count() == 0
    assert secrets.scan(table(spark, [(1, "only short words here")])).count() == 0


LINES = [
    # (text, secrets in it); none of them is made by the planted findings
    ("please use password=Tr0ub4dor&3 today", ["Tr0ub4dor&3"]),
    ('{"user":"bob","api_key":"9f8a7b6c5d4e3f2a1b0c9d8e"}', ["9f8a7b6c5d4e3f2a1b0c9d8e"]),
    ("see https://site.example.org/a/b?user=bob&token=9f8a7b6c5d4e3f2a1b0c and", ["9f8a7b6c5d4e3f2a1b0c"]),
    ("postgres://user:S3cretPassw0rd@db.host/x", ["S3cretPassw0rd"]),
    ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYzzKEYabcdefg", ["wJalrXUtnFEMIK7MDENGbPxRfiCYzzKEYabcdefg"]),
    ("commit 1c5c31775edb0e97c8e972c4a50a0d9e0560c638 was", []),
    ("the password: please ask the office", []),
    ("visit https://www.garden-stone.org/paper/winter/story.html now", []),
    ('password = "changeme" and token = "${TOKEN}"', []),
    ("sha256: 8d969eef6ecad3c29a3a629280e686cf0c3f5d5a86aff3ca12020c923adc6c92", []),
]


def test_forms_of_secrets_and_their_look_alikes(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lines = table(spark, [(-1 - i, text) for i, (text, _) in enumerate(LINES)])
    found = secrets.scan(docs.union(lines)).where("is_secret AND doc_id < 0").collect()
    assert sorted((r.doc_id, r.value) for r in found) == sorted((-1 - i, v) for i, (_, s) in enumerate(LINES) for v in s)
    keys = {r.value: r.key for r in found}
    assert keys["Tr0ub4dor&3"] == "password" and keys["S3cretPassw0rd"] == "password"
    assert keys["9f8a7b6c5d4e3f2a1b0c9d8e"] == "api_key" and keys["9f8a7b6c5d4e3f2a1b0c"] == "token"


def candidates_by_hand(text):
    """(position, value, key, assigned), piece by piece."""
    import re

    name = re.compile(rf"(?:^|_)(?:{'|'.join(secrets.SECRET_PARTS)})[0-9]*(?:_|$)")
    own = lambda s: re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s).lower()).strip("_")
    text = re.sub(r"[&?](?=[A-Za-z0-9_.\-]{1,64}=)", " ", text or "")
    pieces = re.findall(r"""[=:]+>?|["'`]?[^\x20\x09-\x0D"'`,;=:]+["'`]?""", text)
    out = []
    for i, piece in enumerate(pieces):
        back = ["", "", "", *pieces[:i]]
        sign = back[-1][:1] in ("=", ":") and back[-1] != ""
        if piece[0] in "=:":
            continue
        key, value = (back[-2] if sign else back[-1]), re.sub(r"""^["'`(\[{<*#|]+|["'`)\]}>*#|.]+$""", "", piece)
        if back[-1] == ":" and back[-2].startswith("//") and "@" in piece:
            key, value = "password", re.match("([^@/]*@)?", piece).group()[:-1]
        elif back[-2][:1] in ("=", ":") and back[-2] and back[-1].lower() in ("bearer", "basic"):
            key, sign = back[-1], True
        if value and (len(value) >= secrets.SHORTEST or (sign and name.search(own(key)))):
            out.append((i, value, own(key), sign))
    return out


def test_candidates_by_brute_force(spark):
    draw = random.Random(9)
    parts = ["password", "apiKey", "=", ":", " ", " ", ", ", '"', "'", "&", "?", "x", "user", "//", "@", "4f5a6b7c8d9e0f1a2b", "a" * 20, "Bearer", ";", ".", "\n", "é"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(300)]
    rows = list(enumerate([*texts, *(text for text, _ in LINES), None, "", "w" * 100_000 + " token=" + "k9" * 50_000]))
    found = secrets.candidates(clashing(table(spark, rows))).collect()
    expected = [(d, *c) for d, text in rows for c in candidates_by_hand(text)]
    assert sorted((r.id, r.position, r.value, r.key, r.assigned) for r in found) == sorted(expected)
    assert len(expected) > 100


def test_transitions_and_coverage_by_brute_force(spark):
    import math
    import re
    from collections import Counter

    texts = [words(50, 1), words(70, 2) + " Größe x1y2 snake_case", None, "stone stone stone", ""]
    counted = secrets.word_counts(table(spark, list(enumerate(texts))))
    runs = [w for t in texts for w in re.split("[^a-zà-öø-ÿ0-9_]+", (t or "").lower())]
    expected = Counter(w for w in runs if len(w) >= 2 and not re.search("[0-9_]", w))
    assert dict(rows_of(counted)) == expected
    pairs = Counter()
    for w, n in expected.items():
        for a, b in zip(w, w[1:], strict=False):
            pairs[a, b] += n
    letters = secrets._ALPHABET
    for at, found in enumerate(secrets.transitions(counted)):
        a, b = letters[at // 36], letters[at % 36]
        total = sum(pairs[a, c] + 1 for c in letters)
        assert math.isclose(found, math.log((pairs[a, b] + 1) / total)), (a, b)
    values = ["stone-garden", "xyz9stone", "12345", "größe/STONE"]
    found = dict(rows_of(secrets.with_coverage(spark.createDataFrame([(v,) for v in values], "value string"), counted)))
    most = math.log(max(*expected.values(), 2))
    for v in values:
        known = [p for p in re.split("[^a-zà-öø-ÿ]+", v.lower()) if len(p) >= 3 and p in expected]
        assert math.isclose(found[v], sum(len(p) * math.log(expected[p]) / most for p in known) / len(v)), v


def test_forest_on_findings_it_has_not_seen(spark, sf_dir):
    counted = secrets.word_counts(read(spark, sf_dir, "documents"))
    likelihoods = secrets.transitions(counted)
    forest = secrets.fit(secrets.labelled(secrets.planted(spark, counted), counted, likelihoods))
    unseen = secrets.labelled(secrets.planted(spark, counted, seed=99), counted, likelihoods)
    seen = secrets.scored(unseen, forest).select("label", "is_secret").collect()
    assert len(seen) > 10_000 and sum((r.label == 1) == r.is_secret for r in seen) / len(seen) > 0.98


def test_findings_given_by_the_caller(spark):
    rows = [(f"{words(3, i)} id={'ab'[i % 2]}{'12345678901234567' if i % 2 else 'zzyyxxwwvvuuttss'}{i}", i) for i in range(200)]
    findings = [(text, text.split("=")[1], float(i % 2)) for text, i in rows]
    given = spark.createDataFrame([*findings, ("id=1", None, 1.0), (None, "x", 0.0)], "text string, value string, label double")
    found = secrets.scan(table(spark, [(i, text) for text, i in rows]), findings=given).collect()
    assert len(found) == 200 and all(r.is_secret == (r.doc_id % 2 == 1) for r in found)

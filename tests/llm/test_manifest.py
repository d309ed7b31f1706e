"""Line dedup, Merkle manifest and token alignment against brute force, on awkward and supplied rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from comparing import differences
from helpers import awkward_rows, clashing, rows_of, table, words

from shelfcast.llm import alignment, line_dedup, merkle, oracle, queries

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# lines


def kept_lines(rows) -> list[tuple]:
    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\v\f\r"))

    first: dict[str, float] = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            at = float("inf") if d is None else d
            first[key(line)] = min(first.get(key(line), at), at)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (float("inf") if d is None else d)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def lined_rows():
    common = "This line stands in every document"
    rows = awkward_rows()
    rows += [(100 + i, f"{words(4, i)}\n{common}\n  {common.upper()}\t\n{words(3, i % 7)}\nshort") for i in range(60)]
    rows += [
        (50, "ñandú ñañ"), (51, "ñandú ñañ"), (52, "ñandú ñañú"), (53, "ñandú ñañú"), (54, "ÑANDÚ ÑAÑÚ"), (55, "\n\n"),
        (56, f"{common}\r\n{common}"), (57, "é" * 9 + "\n" + "é" * 10), (58, "é" * 10 + "\n" + "é" * 9), (59, "a" * 5000 + "\nx"),
        (60, "A" * 5000 + "\n" + words(9000, 3)), (56, f"{common}\r\n{common}"), (56, f"other text beside\n{common}"),
        (None, common), (None, f"{common}\nonly without an id"), (None, "only without an id"), (61, "\x85" + common), (62, "\xa0" + common),
    ]
    return rows


def test_lines_against_brute_force(spark):
    rows = lined_rows()
    for partitions in (1, 7):
        docs = clashing(table(spark, rows)).repartition(partitions)
        found = line_dedup.without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")
        assert rows_of(found) == kept_lines(rows)


def test_a_line_that_fills_several_ranges(spark):
    rows = [(i, f"a line that all have\n{words(2, i)} end\n" + ("once more of some" if i % 3 else "")) for i in range(500, 0, -1)]
    rows += rows[:200]
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        found = rows_of(line_dedup.without_repeated_lines(table(spark, rows)).select("doc_id", "n_lines", "n_dropped", "text"))
    finally:
        spark.conf.set(merged, "true")
    assert found == kept_lines(rows)


def test_bitmaps_tell_the_lines(spark):
    rows = [(1, "first of two lines\nx"), (2, "y\nFIRST of two lines \nz\n"), (3, "nothing repeats here")]
    only = line_dedup.keep_bitmaps(table(spark, rows)).collect()
    assert [(r.id, r.n_lines, r.n_dropped) for r in only] == [(2, 4, 1)]
    bits = np.unpackbits(np.frombuffer(zlib.decompress(only[0].keep), "u1"), bitorder="little")
    assert bits[:4].tolist() == [1, 0, 1, 1]


def test_no_lines_in_nothing(spark):
    assert line_dedup.without_repeated_lines(table(spark, [])).count() == 0


# Merkle manifest


def manifest_by_hand(rows) -> list[tuple]:
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def lowered(row):
        t = row[4]
        return (*row[:4], t if t is None else re.sub("[A-Z]", lambda m: m.group().lower(), t))

    def levels(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [sha(*nodes[i: i + 8]) for i in range(0, len(nodes), 8)]
            out.append(nodes)
        return out

    def way(tree, at):
        for level in tree[:-1]:
            yield at % 8, [x for i, x in enumerate(level[at // 8 * 8: at // 8 * 8 + 8]) if i != at % 8]
            at //= 8

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, members = {}, {}
    for lang in langs:
        mine = [(r[0] is not None, r[0] or 0, sha(*map(field, r)), r) for r in rows if r[2] == lang]
        members[lang] = sorted(mine, key=lambda m: m[:3])
        trees[lang] = levels([m[2] for m in members[lang]])
    over = levels([trees[lang][-1][0] for lang in langs])
    root, out = over[-1][0], []
    for k, lang in enumerate(langs):
        for at, (_, _, leaf, row) in enumerate(members[lang]):
            steps = [*way(trees[lang], at), *way(over, k)]
            node = leaf if row[0] is None or zlib.crc32(str(row[0]).encode()) % 3 else sha(*map(field, lowered(row)))
            for place, others in steps:
                node = sha(*others[:place], node, *others[place:])
            proof = sha(*[x for _, others in steps for x in others])
            out.append((row[0], leaf, trees[lang][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def signed(spark, rows, partitions=3):
    docs = clashing(spark.createDataFrame(rows, FIELDS)).repartition(partitions)
    claimed = merkle.tampered(docs["text"], docs["doc_id"])
    return merkle.manifest(docs, claimed)


def manifest_rows():
    rows = [(d, "s", "en" if i % 3 else "de", None if i % 5 == 0 else i, t) for i, (d, t) in enumerate(awkward_rows())]
    rows += [(200 + i, None, None, i, "Some Text") for i in range(20)] + [(300, "s", "", 1, "x"), (301, "s", "=", 1, "X")]
    rows += [(400 + i, "s", f"lang{i}", 1, "A") for i in range(9)] + [(None, None, None, None, None)] * 3
    return rows + [(500 + i, f"é{i}", "ü", i, words(3, i)) for i in range(65)]


def test_manifest_against_brute_force(spark):
    rows = manifest_rows()
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for partitions in (1, 5):
        assert rows_of(signed(spark, rows, partitions).select(*columns)) == manifest_by_hand(rows)


def test_manifest_of_several_blocks(spark):
    rows = [(i, "s", "en", i, f"Text {i % 50}") for i in range(9000)] + [(7, "s", "en", 7, "Text 7")] * 500
    rows += [(i, "s", "de", i, "x") for i in range(4096)] + [(i, "s", "fr", i, "x") for i in range(4097)] + [(1, "s", "es", 1, "x")]
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(signed(spark, rows).select(*columns)) == manifest_by_hand(rows)


def test_witnesses_prove_their_rows_only(spark):
    found = signed(spark, manifest_rows()).collect()
    for r in found:
        assert merkle.folded(bytes.fromhex(r.leaf), bytes(r.witness)).hex() == r.root
        assert merkle.proof(bytes(r.witness)).hex() == r.proof_sha256
    other = {bytes(r.witness) for r in found if r.leaf != found[0].leaf} - {bytes(found[0].witness)}
    assert all(merkle.folded(bytes.fromhex(found[0].leaf), w).hex() != found[0].root for w in itertools.islice(other, 30))


def test_no_manifest_of_nothing(spark):
    assert signed(spark, []).count() == 0


def test_manifest_of_the_tables(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    rows = [(d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"]) for d in docs]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(queries.op11_merkle_manifest(spark, sf_dir).select(*names)) == manifest_by_hand(rows)


# alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary())
    whole.encode_special_tokens = True
    return whole, sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.PIECES))


def aligned_by_hand(rows, tokenizers) -> list[tuple]:
    whole, pieces = tokenizers
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in seen}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}

    def ends(tokens):
        return list(itertools.accumulate(map(len, tokens)))

    counts, found = Counter(), []
    for d, text in rows:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in whole.id_to_token(i)) for i in a]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i in b for p in [pieces.id_to_piece(i)]
        ]
        if not text or {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + text).encode()}:
            found.append((d, [], [], [], ""))
            continue
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        links, groups, i, j = [], [], 0, 0
        for cut in sorted({*ends_a} & {*ends_b}):
            to_a, to_b = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(map(str, a[i:to_a])) + "|" + ",".join(map(str, b[j:to_b])))
            links.append((a[to_a - 1], b[to_b - 1]))
            i, j = to_a, to_b
        counts.update(links)
        found.append((d, a, b, links, ";".join(groups)))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return sorted(
        (
            (
                d, len(a), len(b), len(links), len(links), sum(counts[x] == highest[x[1]] for x in links),
                sum(counts[x] for x in links), sha(groups) if groups else "", groups,
            )
            for d, a, b, links, groups in found
        ),
        key=repr,
    )


def token_rows():
    return awkward_rows() + [
        (600, "two  spaces   and \n\n lines\t\ttabs "), (601, "  ahead"), (602, " "), (603, "ends "), (604, "a▁b"), (605, "ﬁne ½ ①"),
        (606, "<s> </s> <unk> <|endoftext|> <0x41>"), (607, "\x00\x01 zero"), (608, "日本語の文章と emoji 🙂🙃 é"), (609, "x" * 3000),
        (610, "=" * 500 + " " * 300 + "don't I'll"), (611, "　wide\xa0space​"), (612, words(3000, 12)), (613, "Ünïcödé ñandú"),
    ]


def test_alignment_against_brute_force(spark, tokenizers):
    rows = token_rows()
    for partitions in (1, 6):
        docs = clashing(table(spark, rows)).repartition(partitions)
        found = alignment.align(docs, queries.vocabulary(), queries.vocabulary(queries.PIECES))
        assert rows_of(found) == aligned_by_hand(rows, tokenizers)


def test_alignment_of_the_tables(spark, sf_dir, tokenizers):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    expected = aligned_by_hand([(d["doc_id"], d["text"]) for d in docs], tokenizers)
    assert rows_of(queries.op12_token_alignment(spark, sf_dir)) == [r[:-1] for r in expected]


def test_cuts_of_random_intervals():
    draw = np.random.default_rng(3)
    for share in (0.05, 0.5, 0.95):
        ends, borders = [[], []], [[0], [0]]
        begin = 0
        for n in draw.integers(0, 60, 40):
            for side in (0, 1):
                mine = np.flatnonzero(draw.random(n) < share) + 1
                mine = np.union1d(mine, [n]) if n else mine
                ends[side] += (begin + mine).tolist()
                borders[side].append(len(ends[side]))
            begin += int(n)
        a, b = (np.array(x) for x in ends)
        got = alignment.cut(a, b, *(np.array(x) for x in borders))
        common = np.intersect1d(a, b)
        for side, x in ((0, a), (1, b)):
            assert got[side].tolist() == [0, *(np.searchsorted(x, common[:-1]) + 1).tolist()]


def test_long_texts_are_encoded_in_parts(tokenizers, monkeypatch):
    model = alignment.piece_model(queries.vocabulary(queries.PIECES))
    texts = [words(300, 4), "a  b   c " * 100, " " * 700, "x" * 500 + "   " + "y" * 500 + " ", "no space" + "z" * 900, "", "q" + " " * 40 + "r " * 30]
    expected = [tokenizers[1].encode(t) for t in texts]
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(alignment, "PART", size)
        assert [model.encode(t) for t in texts] == expected


def test_no_alignment_of_nothing(spark, tokenizers):
    assert alignment.align(table(spark, []), queries.vocabulary(), queries.vocabulary(queries.PIECES)).count() == 0
    blank = alignment.align(table(spark, [(1, None), (1, "")]), queries.vocabulary(), queries.vocabulary(queries.PIECES))
    assert rows_of(blank) == [(1, 0, 0, 0, 0, 0, 0, "", "")] * 2


def test_lines_of_the_tables(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert differences(queries.op13_line_dedup(spark, sf_dir), con, oracle.OP13) == []

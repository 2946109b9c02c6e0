"""Alignment of two tokenizers against a plain restatement, and on odd rows."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from rowsight.llm import alignment, queries

SF = "/root/testdata/sf0.001"


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        printable = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
        names, more = {}, 0
        for byte in range(256):
            if byte in printable:
                names[chr(byte)] = byte
            else:
                names[chr(256 + more)] = byte
                more += 1
        self.names = names

    def tokens(self, text):
        coded = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.names[c] for c in t)) for i, t in zip(coded.ids, coded.tokens)]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:-1], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()))
        body = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == body == b"".join(x for _, x in b) else ([], [])

    def links(self, text):
        """(groups, links as id pairs)"""
        a, b = self.tokens(text)
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, token in side:
                out.append((i, at, at + len(token)))
                at += len(token)
            spans.append(out)
        both = {e for *_, e in spans[0]} & {e for *_, e in spans[1]}
        sides = []
        for side in spans:
            closed = [[]]
            for i, _, e in side:
                closed[-1].append(str(i))
                if e in both:
                    closed.append([])
            sides.append(closed[:-1])
        groups = ["|".join(map(",".join, g)) for g in zip(*sides, strict=True)]
        links, start = [], 0
        for i, s, e in spans[0]:
            while spans[1][start][2] <= s:
                start += 1
            at = start
            while at < len(spans[1]) and spans[1][at][1] < e:
                links.append((i, spans[1][at][0]))
                at += 1
        return len(a), len(b), groups, links


def plain(rows):
    tool = Plain()
    found = [(i, *(tool.links(text) if text else (0, 0, [], []))) for i, text in rows]
    held = Counter(p for *_, links in found for p in set(links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for i, n_a, n_b, groups, links in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha))
    return sorted(out, key=repr)


def test_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.op11_tokenizer_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n\n\t  double  spaces "), (5, "<|endoftext|></s><s> [INST] <0x41> <unk>"), (6, "日本語のテキスト 🙂🙃 naïve café"),
    (7, "a ▁ b"), (8, "nul \x00 byte"), (9, "ﬁ ligature ½ Å"), (10, "word " * 40_000), (11, "repeated text"), (12, "repeated text"), (12, "repeated text"),
    (None, "no id"), (13, "́‍ ‮﻿"), (14, "x" * 30_000),
]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(ODD)], "doc_id bigint, text string, n_a int")
    got = alignment.aligned(docs, with_groups=True, keep=("n_a",))
    assert got.columns == ["doc_id", "n_a", "n_a_", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    rows = got.collect()
    assert sorted((tuple(r)[0], *tuple(r)[2:9]) for r in rows if r.doc_id) == sorted(r for r in plain(ODD) if r[0])
    by_row = {r.n_a: r for r in rows}
    assert sorted(by_row) == list(range(len(ODD)))
    assert by_row[0].groups_sha256 == by_row[1].groups_sha256 == by_row[6].groups_sha256 == ""
    for r in rows:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
        if r.groups:
            sides = [g.split("|") for g in r.groups.split(";")]
            assert [sum(len(g[k].split(",")) for g in sides) for k in (0, 1)] == [r.n_a_, r.n_b] and len(sides) == r.n_groups


def test_no_rows_and_no_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [tuple(r)[1:] for r in alignment.aligned(docs).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert alignment.aligned(docs.limit(0)).count() == 0


def test_chunks_don_t_matter(spark, monkeypatch):
    rows = [(i, f"some {i} words that {i * i} differ and some that don't {i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(alignment, "CHUNK", 200)
    assert sorted(map(tuple, alignment.aligned(docs).collect()), key=repr) == plain(rows)

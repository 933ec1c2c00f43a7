import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chronotaxa.llm import sentencepiece_codec as S
from chronotaxa.llm import token_alignment as T

A, B = S.tokenizer_path("byte_bpe_50k.json"), S.tokenizer_path("piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not Path(A).exists() or not Path(B).exists(), reason="no tokenizer files")

ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "1", "!", " ", "　", "日", "\x1c", "\x85", "the ", "word ", "<|endoftext|>", "<s>", "<0x0A>", "😀", ".", ", ", "é ", "ation", "<unk>", "\x00"]


@pytest.fixture(scope="module")
def models():
    return Path(A).read_bytes(), Path(B).read_bytes()


def texts(seed, n, most=30, more=()):
    rng = random.Random(seed)
    return ["".join(rng.choice([*ALPHABET, *more]) for _ in range(rng.randint(0, most))) for _ in range(n)]


def ends(sizes):
    out, at = [], 0
    for n in sizes:
        at += n
        out.append(at)
    return out


class Plain:
    """What the contract says, text by text, with the libraries themselves."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def groups(self, text):
        if not text:
            return []
        want = b" " + text.encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        in_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        in_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(in_a) != want or b"".join(in_b) != want:
            return []
        ends_a, ends_b = ends(map(len, in_a)), ends(map(len, in_b))
        out, k, m = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e) + 1, ends_b.index(e) + 1
            out.append((a[k:x], b[m:y]))
            k, m = x, y
        return out

    def digests(self, rows):
        groups = [self.groups(t) for _, t in rows]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
        n = Counter(p for c in links for p in c)
        most = [defaultdict(int), defaultdict(int)]
        for p, k in n.items():
            for side in (0, 1):
                most[side][p[side]] = max(most[side][p[side]], k)
        out = []
        for (doc_id, _), g, c in zip(rows, groups, links):
            written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            best = [sum(k for p, k in c.items() if n[p] == most[side][p[side]]) for side in (0, 1)]
            out.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), best[0], sum(n[p] * k for p, k in c.items()), hashlib.sha256(written.encode()).hexdigest() if g else "", best[1]))
        return sorted(out, key=str), n, most


@pytest.fixture(scope="module")
def plain():
    return Plain()


def rows():
    data = [None, "", " ", "a", "a ", "a  ", " a", "\n", "the word's end", "x" * 700, " " * 300, "ab " * 300, "日本 " * 50, "marker ▁ inside", "▁", "éé éé ", *texts(1, 250), *texts(2, 60, 12, ["▁"])]
    return [*enumerate(data), (3, "the word's end"), (None, "the word"), (None, None)]


@pytest.mark.parametrize("block", [T.BLOCK, 100])
def test_digests(spark, models, plain, block):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, pair string, n long").repartition(3)
    got = sorted((tuple(r) for r in T.digests(df, *models, block).collect()), key=str)
    assert got == plain.digests(rows())[0]
    assert sum(r[1] > 0 for r in got) > 200


def test_groups_and_counts(spark, models, plain):
    df = spark.createDataFrame(rows(), "doc_id long, text string").where("doc_id is not null and doc_id <> 3")
    kept = [(i, t) for i, t in rows() if i not in (None, 3)]
    got = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in T.alignments(df, *models, 500).collect()}
    assert got == {i: plain.groups(t) for i, t in kept}
    _, n, most = plain.digests(kept)
    assert {(r.a, r.b): (r.n, r.most_a, r.most_b) for r in T.pair_counts(df, *models, 500).collect()} == {p: (k, most[0][p[0]], most[1][p[1]]) for p, k in n.items()}


def test_empty_table(spark, models):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.digests(df, *models).count() == 0 and T.alignments(df, *models).count() == 0


def test_wide_groups_are_counted_by_ids(models, monkeypatch):
    """The same sums, whether links are written out or not."""
    sides = T.Sides(*models)
    units = [t.encode() for t in (" the word", " " + "x" * 400, " 日本日本日本", " ")]
    one = T.Aligned(sides, units)
    monkeypatch.setattr(T, "LINKS", 1)
    other = T.Aligned(sides, units)
    assert _sums(one, len(units)) == _sums(other, len(units)) and one.counts.tolist() == other.counts.tolist()


def _sums(x, n_units):
    out = Counter()
    for u, p, n in zip(np.repeat(np.arange(n_units), x.n_pairs).tolist(), x.pair.tolist(), x.times.tolist()):
        out[u, p] += n
    return out


def test_merge_of_ends():
    rng = random.Random(4)
    for _ in range(100):
        a, b = (np.array(sorted(rng.sample(range(1, 60), rng.randint(0, 40))), np.int64) for _ in range(2))
        in_a, in_b = T.merged(a, b)
        assert a[in_a].tolist() == b[in_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_other_vocabularies_are_refused(models):
    with pytest.raises(ValueError):
        T.read_byte_level(Path(S.tokenizer_path("word_bpe_49k.json")).read_bytes())


def test_ids_are_those_of_the_file(models, plain):
    """The file's own library gives the same ids, also beside rare and unassigned characters."""
    from chronotaxa.llm.byte_bpe import encoding

    enc = encoding(T.read_byte_level(models[0]))
    some = [*texts(8, 500), "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in [*range(0x80, 0x2100), *range(0x16FE0, 0x17000), *range(0x30000, 0x30100)])]
    for t in some:
        assert enc.encode_ordinary(t) == plain.a.encode(t, add_special_tokens=False).ids

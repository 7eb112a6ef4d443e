"""op1, op3, op8 against brute force and the public libraries."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from apisieve.llm import bpe, packing, pii, queries

from .conftest import SF

WEIRD = [None, "", " ", "a", "  a  b \n \n c  ", "x" * 5000, "a@b.c@d.e f@g.h", "1.2.3.4.5.6.7.8 300.1.1.1 01.02.03.004", "🙂 é  ü\t\n", "<|endoftext|> a<|endoftext|>", "4111 1111 1111 1111", "+1 (555) 010-9999."]


def plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1234567890.@+-() %_é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail john (at) example (dot) com now", [("email", "john (at) example (dot) com")]),
        ("mail john at mail dot example dot com now", [("email", "john at mail dot example dot com")]),
        ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
        ("call plus one five five five zero one zero nine nine nine nine ok", [("phone", "plus one five five five zero one zero nine nine nine nine")]),
        ("host one nine two dot one six eight dot zero dot one", [("ip", "one nine two dot one six eight dot zero dot one")]),
        ("４１１１ １１１１ １１１１ １１１１", [("card", "４１１１ １１１１ １１１１ １１１１")]),
        ("jo​hn[at]example[.]org", [("email", "jo​hn[at]example[.]org")]),
        ("we met at noon, one two three, at the dot", []),
    ],
)
def test_disguises(text, want):
    base, added = pii.all_spans(text)
    assert [(k, text[a:b]) for k, a, b in base + added] == want


def test_op1(spark):
    docs = spark.createDataFrame(list(enumerate(WEIRD)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for k, text in enumerate(WEIRD):
        assert got[k].base_spans == pii.joined(plain(text or ""))
    assert "[EMAIL]" in pii.redact(docs).filter("doc_id = 6").first().text
    assert queries.op1_pii(spark, SF).count() == 200


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_pack(lengths):
    rows = packing.pack(lengths)
    seen, filled = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in rows:
        assert n > 0
        seen[d].append((s, n))
        filled[q].append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen[d]):
            assert s == at
            at += k
        assert at == n
    for q in filled.values():
        at = 0
        for o, k in sorted(q):
            assert o == at
            at += k
        assert at <= 1024 and at & (at - 1) == 0


def test_op3(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(WEIRD)] + [(None, "n"), (3, "a")], "doc_id long, text string")
    ids = defaultdict(dict)
    for r in packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json"), queries.pattern()).collect():
        ids[r.doc_id][r.start] = r.ids
    for k, text in enumerate(WEIRD):
        want = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(v for _, v in sorted(ids[k].items())) == want, text
    rows = queries.op3_packing(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == texts.keys()
    for d, text in texts.items():
        want = [*tok.encode(text, add_special_tokens=False).ids, 0]
        for r in by_doc[d]:
            assert r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in by_doc[d]) == len(want)


def test_op8(spark):
    import tiktoken

    ranks = bpe.load_ranks(queries.tokenizer("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=queries.pattern(), mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(ranks, queries.pattern())
    rng = np.random.default_rng(0)
    for text in [*WEIRD, "ab" * 3000, "".join(chr(97 + x) for x in rng.integers(0, 26, 4000)), "aaaa " * 50, "\x00\x01é" * 500]:
        assert own.ids(text or "").tolist() == coder.encode_ordinary(text or ""), text
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op8_bpe(spark, SF).collect():
        ids = coder.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

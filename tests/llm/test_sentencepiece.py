import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from weftgraph.llm import sentencepiece_stream as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"ab the'sldrem  \n\t  \x85\x1c　é漢😀09.,!?'▁▁", "<s>", "the", "    ", "<0x41>"]


@pytest.fixture(scope="module")
def both():
    return S.StreamingEncoder(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_ids_equal_the_library_and_decode(both):
    ours, library = both
    for x in texts(3000):
        ids = library.encode(x)
        assert ours.encode(x) == ids, x
        assert ours.decode(ids) == library.decode(ids) == x.replace("▁", " "), x


def test_streaming_equals_the_library(both):
    ours, library = both
    for x in texts(800, 2):
        if x:
            characters = ours.stream(iter("▁" + x.replace(" ", "▁")))
            assert [i for ids in characters for i in ids] == library.encode(x), x


def test_every_word_runs_through_the_stream(both):
    ours, library = S.StreamingEncoder(PATH), both[1]
    own, seen = ours.stream, 0

    def counted(chunks):
        nonlocal seen
        chunks = list(chunks)
        seen += sum(map(len, chunks))
        return own(chunks)

    ours.stream = counted
    text = " ".join(["one", "two", "é漢", "y" * 63, "y" * 64, "y" * 500, "one"])
    assert ours.encode(text) == library.encode(text)
    assert seen == len(" " + text) - len(" one")  # the memo serves a word that came before, and nothing else does


def test_other_models_are_refused(tmp_path):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        with pytest.raises(Exception):
            S.StreamingEncoder(public_tokenizers.path(name))
    message = lambda n, data: bytes([n << 3 | 2, len(data)]) + data
    for trainer, rules in ((b"\x18\x01", b""), (b"\x18\x02", message(2, b"rules"))):
        path = tmp_path / "m.model"
        path.write_bytes(message(2, trainer) + message(3, rules + b"\x20\x00"))
        with pytest.raises(ValueError):
            S._checked(str(path), both_pieces())


def both_pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_stream_holds_a_bounded_window(both):
    ours, library = both
    read = 0

    def characters():
        nonlocal read
        for c in "▁" + "abcdefgh" * 4000:
            read += 1
            yield c

    given, behind = 0, 0
    for ids in ours.stream(characters()):
        given += sum(len(ours.pieces[i]) for i in ids)
        behind = max(behind, read - given)
    assert given == read and behind < 3 * ours.longest


def test_pairs_are_stable_as_the_merges_say(both):
    ours, _ = both
    rnd = random.Random(4)
    pieces = list(ours.ids)
    for _ in range(3000):
        a, b = rnd.choice(pieces), rnd.choice(pieces)
        assert ours._fits(ours.ids[a], ours.ids[b]) == (ours.merged(a + b) == [a, b]), (a, b)


def test_defined_cases(spark, both):
    long = "x" * 100000
    rows = [(1, None, "a"), (2, "", "a"), (3, "naïve 漢字", "a"), (3, "naïve 漢字", "a"), (4, long, "a"), (None, "b", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = {(r.doc_id, r.text): r.ids for r in S.encode(df, PATH).collect()}
    assert encoded == {(i, t): both[1].encode(t or "") for i, t, _ in rows}
    back = {(r.doc_id, r.text): r.again for r in S.decode(S.encode(df, PATH), PATH, text_col="again").collect()}
    assert back == {(i, t): t or "" for i, t, _ in rows}
    for r in S.encoded_digests(df, PATH).collect():
        ids = both[1].encode(dict((i, t or "") for i, t, _ in rows)[r.doc_id])
        assert (r.n_ids, r.ids_sha256, r.round_trip) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True)
    assert S.encode(df.where("doc_id < 0"), PATH).count() == 0

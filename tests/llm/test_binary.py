import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import clashing, rows_of
from tokenizers import Tokenizer

from loglattice.llm import binary, storage, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_round_trip_matches_the_tokenizer(spark, awkward, awkward_rows, tokenizer):
    got = rows_of(binary.round_trip(spark, clashing(awkward)))
    want = sorted((r[0] is not None, r[0] or 0, len(ids), crc(ids)) for r in awkward_rows for ids in [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]])
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == want
    ordered = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in ordered] == np.cumsum([0, *(r[2] for r in ordered)])[:-1].tolist()
    ids = [(r[0] is not None, r[0] or 0) for r in ordered]
    assert ids == sorted(ids)


def test_empty_table(spark, nothing):
    assert binary.round_trip(spark, nothing).count() == 0


def _file(frame_tokens=10):
    out = io.BytesIO()
    writer = binary.FrameWriter(out, frame_tokens)
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 49000, k % 13).astype(np.uint32)) for k in range(100)]
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    return out, docs


def test_only_wanted_frames_are_read():
    out, docs = _file()
    reader = binary.FrameReader(out)
    assert [k for f in range(len(reader.entries)) for k, _ in reader.frame(f)] == [k for k, _ in docs]
    seen = []
    frame = reader.frame
    reader.frame = lambda k: seen.append(k) or frame(k)
    found = dict(reader.documents([7, 50, 51, 999]))
    assert sorted(found) == [7, 50, 51] and all((found[k] == docs[k][1]).all() for k in found)
    assert len(seen) <= 3 < len(reader.entries)


def test_damage_is_noticed():
    out, _ = _file()
    data = bytearray(out.getvalue())
    reader = binary.FrameReader(io.BytesIO(bytes(data)))
    reader.entries = reader.entries.copy()
    reader.entries[0, 2] ^= 1
    with pytest.raises(ValueError):
        list(reader.frame(0))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        binary.FrameReader(io.BytesIO(bytes(data)))


def test_chunk_table_forgets(tokenizer):
    encoder = tokens.ChunkEncoder(table_size=50)
    rng = np.random.default_rng(3)
    for _ in range(6):
        texts = [" ".join(f"Word{rng.integers(0, 300)}" for _ in range(40)) + " Été　x <|endoftext|>y" for _ in range(5)]
        got = encoder.encode([t.encode() for t in texts])
        assert [ids.tolist() for ids in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_lie_in_the_shared_folder(spark, awkward):
    manifest = binary.write(awkward, storage.fresh(spark, "token-files"))
    assert all(r["path"].startswith(storage.shared_dir(spark)) for r in manifest.collect())

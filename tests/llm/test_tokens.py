import random

import pyarrow as pa
import pytest

from loglattice.llm import tokens
from loglattice.llm.tokens import ChunkEncoder


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder()


def test_same_ids_as_the_tokenizer(encoder):
    rng = random.Random(3)
    letters = ["abcdefghijklmnop", "ABCxyz", "éßÄñ", "0123", "'s!?.,#", "_<|>"]
    word = lambda: "".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(1, 12)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["", " \t\n", "plain words only", f"a {encoder.mark} b x{encoder.mark}y", "Don't <|endoftext|> STOP", "z" * 5000]
    texts += ["H\u0331am J\u030cAN T\u0308 W\u030aX Y\u030A é E\u0301COLE ÉTÉ Upper", "O\u031b\u0301N Ἀ A\u0345 Mixed Case"]
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.letters_whole
    assert [ids.tolist() for ids in encoder.encode([t.encode() for t in texts])] == want
    fresh = ChunkEncoder()
    fresh.letters_whole = False
    assert [ids.tolist() for ids in fresh.encode([t.encode() for t in texts])] == want


def test_forgetting_keeps_ids():
    small = ChunkEncoder(table_size=10)
    for text in ("one two three four", "five six, seven ate nine ten eleven", "one twelve two thirteen", ""):
        assert small.encode([text.encode()])[0].tolist() == small.tokenizer.encode(text, add_special_tokens=False).ids


def test_punctuation_behind_a_word_costs_no_encoding():
    fresh, added, plain = ChunkEncoder(), [], []
    encode, whole = fresh._encode_chunks, fresh._plain
    fresh._encode_chunks = lambda chunks: added.extend(chunks) or encode(chunks)
    fresh._plain = lambda texts: plain.extend(texts) or whole(texts)
    text = "Word word, word. word!! straße straße; straße.### Été, ÉTÉ"
    assert fresh.encode([text.encode()])[0].tolist() == fresh.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(c.decode() for c in added if c.decode()[-1].isalpha()) == ["straße", "word", "ÉtÉ", "Été"]
    assert not any(letter in some for some in plain for letter in "wordß")


def test_same_ids_with_accents_and_punctuation():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeABCDE" + "".join(map(chr, range(0xA1, 0x180)))) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    tails = ["".join(rng.choice("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for _ in range(rng.randint(0, 4))) for _ in range(400)]
    texts = [" ".join(a + b for a, b in zip(stems[k : k + 20], tails[k : k + 20], strict=True)) for k in range(0, 400, 20)]
    texts += ["it's IT'S it' its' it's, 'tis don'tx l'd,", "a× ×a ÷, é÷, Éß× ßſ, µ, ª. º", "é, É. ≠ a≠ ç,", "one<|endoftext|> one<| one|> <|startoftext|>, é<|endoftext|>É,"]
    texts += ["a\x1cb, a\x00, a\x7f. é , É　x. 中, 中文。 ё. Σ, ΑΣ. İ, ǅ. 1, a1, 1a, ½, a½."]
    for encoder in (ChunkEncoder(), ChunkEncoder(table_size=10)):
        for text in texts * 2:
            assert encoder.encode([text.encode()])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_task_leaves_no_table_behind():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words, été!", None]})
    ids = [(key, row.tolist()) for key, row in tokens.encoded(iter([batch, batch]), tokens.TOKENIZER, 1)]
    left = tokens.encoder(tokens.TOKENIZER)
    assert ids == 2 * [(1, [*left.tokenizer.encode("some words, été!", add_special_tokens=False).ids, 1]), (2, [1])]
    assert not left.table and left.ids.nbytes + left.ends.nbytes < 1 << 19

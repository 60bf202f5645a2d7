from cases import clashing, rows_of
from plain import quality as plain

from loglattice.llm import quality

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "base_failed", "kept")


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_matches_plain_version(awkward, awkward_rows):
    got = rows_of(quality.judge(clashing(awkward)).select(*COLUMNS))
    assert sorted(got, key=key) == sorted([(r[0], *plain(r[1])) for r in awkward_rows], key=key)


def test_kept_rows_keep_their_columns(awkward, awkward_rows, nothing):
    df = clashing(awkward)
    out = quality.keep_documents(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r[0] for r in awkward_rows if plain(r[1])[-1])
    assert quality.keep_documents(nothing).count() == 0 and quality.judge(nothing).count() == 0


def test_policies_and_ablations_from_the_ledger(awkward, awkward_rows):
    bits = [plain(r[1])[5] for r in awkward_rows]
    found = {r["rule"]: (r["failed"], r["only_this_rule"]) for r in quality.ablations(quality.ledger(awkward), quality.STANDARD).collect()}
    want = {rule: (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits)) for k, rule in enumerate(quality.RULES)}
    assert found == want
    loose = quality.Policy("loose", ("few_words",))
    assert quality.ledger(awkward).filter(quality.verdict(loose)).count() == sum(not b & 1 for b in bits)


def test_ledger_of_nothing_has_zero_counts(nothing):
    assert {(r["failed"], r["only_this_rule"]) for r in quality.ablations(quality.ledger(nothing), quality.STANDARD).collect()} == {(0, 0)}

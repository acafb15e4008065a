import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from askalot.llm import spelling
from askalot.llm.common import table

SF = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, garble, least=5):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if garble and h % garble == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]


def plain_groups(counts):
    rows = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 5 * n else None
        rows[w] = [form, w, n, len(near), counts[form] if form else None]
    for row in rows.values():
        while rows[row[1]][0]:
            row[1] = rows[row[1]][0]
    return {(w, *row) for w, row in rows.items()}


def got(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_documents_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = plain_groups(plain_words([(r["doc_id"], r["text"]) for r in docs.collect()], 199))
    rows = got(spelling.op11_spelling(spark, SF))
    assert len(rows) == len(want) and set(rows) == want and sum(1 for r in rows if r[1]) > 10


def test_chains_ties_and_accents(spark):
    counts = {"letters": 500, "lettres": 500, "letterz": 60, "letterzz": 6, "lettterzz": 5, "été" * 2: 40, "étéèté": 5, "àbcdef": 5, "bcdefgh": 5, "abcdef": 25, "xbcdef": 25}
    counts |= {"aaaaaa": 1000, "aaaaaaa": 100, "aaaaaaaa": 10, "a" * 300: 5, "a" * 301: 25}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain_groups(counts)
    for crowded in (spelling.CROWDED, 1):
        rows = got(spelling.group_variants(words, crowded=crowded))
        assert len(rows) == len(want) and set(rows) == want
    by = {r[0]: r for r in want}
    assert by["letterzz"][1:3] == ("letterz", "letters") and by["lettres"][1] is None and by["àbcdef"][1] == "abcdef" and by["aaaaaaaa"][2] == "aaaaaa"


def test_crowded_keys_lose_nothing(spark):
    counts = {f"{a}{b}{c}{d}nghi": 5 + (ord(a) * 7 + ord(b)) % 90 for a in "abcd" for b in "abcd" for c in "abcd" for d in "abcd"}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain_groups(counts)
    for crowded in (4, spelling.CROWDED):
        assert set(got(spelling.group_variants(words, crowded=crowded))) == want


def test_odd_rows(spark):
    rows = [(None, "Grösse Größen größen"), (1, None), (2, ""), (3, "x" * 200_000), (4, "œuvre ’letters’ lettersß \U0001f600letters LETTERS"), (4, "letters"), (5, "lettersÀ lettersà letters×")] * 5
    docs = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, word long, n long")
    for garble in (0, 3):
        want = plain_groups(plain_words(rows, garble))
        assert set(got(spelling.spelling_variants(docs, garble=garble))) == want and want
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert got(spelling.spelling_variants(spark.createDataFrame([(1, "only few")], "doc_id long, text string"))) == []


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=6, max_size=11), st.data())
def test_one_edit_shares_a_signature(word, data):
    at, letter = data.draw(st.integers(0, len(word) - 1)), data.draw(st.sampled_from("abcé"))
    others = {word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:]} - {word}
    counts = Counter(c for w in (word, *others) for c in set(spelling.components(w)))
    signer = spelling.Signer({d: spelling.deal(counts.items(), 3, p) for d, p in spelling.PARTS.items()})
    for other in others:
        roles = {(s, r) for s, r in signer.signatures(word)}
        theirs = dict.fromkeys(signer.signatures(other))
        want = {(spelling.SAME, spelling.SAME)} if len(other) == len(word) else {(spelling.SHORTER, spelling.LONGER)}
        assert want <= {(a, b) for s, a in roles for t, b in theirs if s == t}

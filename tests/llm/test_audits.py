"""Spelling variants, filter audit and license scans against brute force, and on awkward rows."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest

from memlattice.llm import filter_audit, licenses, spelling
from memlattice.llm.filter_audit import audit_filters, fail_masks
from memlattice.llm.licenses import BASE_PHRASES, PHRASES, TEXTS, scan_licenses
from memlattice.llm.spelling import Trie, near_words, spelling_variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, word string, n long"
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 0, "p", 1, "w", 1) for i, t, s in rows], DOCS)


# ---- spelling variants ---------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("alphabet", [b"ab", b"a", b"abc\xe9"])
@pytest.mark.parametrize("states", [1 << 16, 7])
def test_automaton_meets_trie_in_all_near_words_once(monkeypatch, alphabet, states):
    monkeypatch.setattr(spelling, "_STATES", states)
    rng = random.Random(3)
    words = sorted({bytes(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(400)})
    of, near = near_words(Trie.of(words), words)
    assert sorted(zip(of.tolist(), near.tolist(), strict=True)) == sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b))


def test_words_longer_than_a_shard():
    words = [b"a" * 3000, b"a" * 3001, b"a" * 2999 + b"b"]
    of, near = near_words(Trie.of(words), words)
    assert sorted(zip(of.tolist(), near.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 0), (2, 0)]


def variants(rows):
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def spelled(rng):
    base = ["spelling", "spellings", "variants", "variante", "Straßeßen", "naïvetés", "Écoliers", "écoliers", "grouping", "grouqing"]
    rows = []
    for k in range(300):
        words = rng.choices(base, [400, 30, 300, 3, 20, 20, 10, 10, 200, 2], k=40)
        if k % 7 == 0:
            words.append("spelliings")
        rows.append((k, " ".join(words) + " 中文tail", "s"))
    chain = ["abcdefga"] * 2 + ["abcdefgb"] * 20 + ["abcdefbb"] * 200 + ["abcdebbb"] * 2000
    return [*rows, (None, " ".join(chain), "s"), rows[0], (900, None, None), (901, "", "s"), (902, "x" * 5000 + " " + "x" * 5000, "s"), (None, "y" * 4999 + " " + "y" * 4999, None)]


@pytest.mark.parametrize("small", [False, True])
def test_variants_match_brute_force(spark, monkeypatch, small):
    if small:  # several shards, several broadcasts
        monkeypatch.setattr(spelling, "SHARD_WORDS", 5)
        monkeypatch.setattr(spelling, "BROADCAST_BYTES", 3000)
    rows = spelled(random.Random(2))
    got = [tuple(r) for r in spelling_variants(frame(spark, rows)).collect()]
    want = variants(rows)
    assert len(got) == len(want) and set(got) == want
    assert ("abcdefga", "abcdefgb", "abcdebbb", 2, 1, 20) in want


def test_variants_of_nothing(spark):
    assert spelling_variants(frame(spark, [])).count() == 0
    assert spelling_variants(frame(spark, [(1, None, None), (2, "short words", "s")])).count() == 0


# ---- filter audit ----------------------------------------------------------------------------------------------


def fails(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    capitals = len(re.findall("[A-Z]", text or ""))
    return (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(text or ""), bool(re.search("[#$%&*|]", text or "")))


def audit(rows, labels):
    kinds = {}
    for i, q, t in labels:
        good, toxic = kinds.get(i, (0, 0))
        kinds[i] = (max(good, int(q == 1)), max(toxic, int(t == 1)))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    facts = [(s or "", {x for x, f in zip("ABCDE", (*fails(t), i is not None and i > least[t or ""]), strict=True) if f}, kinds.get(i, (0, 0)) if i is not None else (0, 0)) for i, t, s in rows]
    out = {}
    for part in {p for p, _, _ in facts}:
        removed = Counter()
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                c = Counter()
                for p, failed, (good, toxic) in facts:
                    if p != part:
                        continue
                    before = bool(failed & set(order[:k]))
                    c["kept"] += not before and x not in failed
                    c["redundant"] += before and x in failed
                    c["unique"] += failed == {x}
                    if x in failed and not before:
                        c["removed"] += 1
                        c["good"] += good
                        c["toxic"] += toxic
                removed[x] += c["removed"]
                out[part, "".join(order), k + 1] = c
        for (p, order, step), c in out.items():
            if p == part:
                c["shapley"] = removed[order[step - 1]]
    return {(*key, *(c[x] for x in ("kept", "removed", "redundant", "unique", "good", "toxic", "shapley"))) for key, c in out.items()}


def audited(rng):
    words = [f"{a}{b}" for a in ("the", "Of", "AND", "été", "x|y", "so") for b in range(12)]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice((5, 49, 50, 80, 200)))), rng.choice(("a", "b", None, ""))) for k in range(60)]
    rows += [(100 + k, rows[k % 5][1], "a") for k in range(12)]
    return [*rows, rows[0], (0, rows[1][1], "b"), (None, rows[2][1], "b"), (None, None, None), (70, None, "a"), (71, "", "b"), (72, "plain words\n" * 40_000, "c"), (73, "ß" * 10, "c")]


def test_audit_matches_brute_force(spark):
    rng = random.Random(4)
    rows = audited(rng)
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1))) for k in range(0, 110, 2)] + [(0, 1, 0), (2, 0, 1), (None, 1, 1)]
    got = [tuple(r) for r in audit_filters(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()]
    want = audit(rows, labels)
    assert len(got) == len(want) == 600 * 4 and set(got) == want
    assert audit_filters(frame(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_masks_do_not_depend_on_blocks_or_hashes(monkeypatch):
    rng = random.Random(9)
    texts = [t for _, t, _ in audited(rng) if not t or len(t) < 5000]
    want = [sum(f << k for k, f in enumerate(fails(t))) for t in texts]
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    assert fail_masks(column).tolist() == want
    from memlattice.llm import common

    for block in (1, 3, 64):
        monkeypatch.setattr(common, "BLOCK", block)
        monkeypatch.setattr(filter_audit, "BLOCK", block)
        monkeypatch.setattr(filter_audit, "_WORDS", block)
        assert fail_masks(column).tolist() == want
    # hashes that all collide: the words themselves decide
    monkeypatch.setattr(filter_audit, "hash_spans", lambda a, s, e, t: spelling.np.zeros(len(s), spelling.np.uint64))
    assert fail_masks(column).tolist() == want
    assert fail_masks(pa.array([], pa.string())).tolist() == []


# ---- license scans ---------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = words(text)
    at = sorted((k, x) for p, x in BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, sorted({x for _, x in at})


def licensed(rng):
    filler = ["under", "the", "mit", "license", "cc", "by", "nc", "apache", "version", "2", "of", "software", "école"]
    rows = [(k, rng.choice((" ", "-", "\n")).join(rng.choices(filler, k=rng.randint(0, 120))), "s") for k in range(150)]
    return [*rows, rows[3], (None, "CC BY-NC, cc by nc", None), (200, None, None), (201, "", "s"), (202, "cc by", "s"), (203, "cc by nc " * 30_000, "s"), (204, "CC-BY-NC", "s")]


def test_base_places_match_brute_force(spark):
    rows = licensed(random.Random(6))
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels)) for r in scan_licenses(frame(spark, rows)).collect())
    assert got == Counter((i, *b[:4], tuple(b[4])) for i, t, _ in rows for b in [base(t)])
    assert scan_licenses(frame(spark, [])).count() == 0


def test_longer_texts_with_changes_are_found(spark):
    rng = random.Random(8)
    rows = []
    for k, (_, text) in enumerate(TEXTS.items()):
        changed = text.split()
        for at in range(12, len(changed) - 5, 17):
            changed[at] = "other"
        changed.insert(len(changed) // 2, "an added word")
        rows += [(3 * k, f"before it {text} after it", "s"), (3 * k + 1, " ".join(["x"] * 40 + changed), "s"), (3 * k + 2, " ".join(rng.sample(text.split(), len(text.split()))), "s")]
    found = {r.doc_id: r for r in scan_licenses(frame(spark, rows)).collect()}
    for k, (label, text) in enumerate(TEXTS.items()):
        whole, changed, shuffled = found[3 * k], found[3 * k + 1], found[3 * k + 2]
        assert label in whole.labels and whole.score == 1.0 and (label, 2, 2 + len(words(text))) in {(s.label, s.start, s.end) for s in whole.spans}
        assert label in changed.labels and licenses.COVERED <= changed.score
        assert shuffled.labels == []


def test_own_phrases_and_copies(spark):
    rows = [(k, f"Text {k}. This is under the GNU General Public License, version 3.", "s") for k in range(40)]
    found = scan_licenses(frame(spark, rows * 3)).collect()
    assert len(found) == 120 and all(r.labels == ["gpl-3"] and r.base_labels == [] and r.n_base == 0 and r.score == 1.0 for r in found)
    assert all(len(p.split()) >= licenses.GRAM for p in PHRASES)



import random

from tessella.llm.common import words_of
from tessella.llm.licenses import BASE_PHRASES, TEMPLATES, LicenseScanner, SuffixAutomaton, disjoint, scan_licenses


def common_suffixes(templates, words, i):
    """(template, end) -> how many words before and at both places are the same, if any."""
    out = {}
    for k, t in enumerate(templates):
        for e in range(len(t)):
            n = 0
            while n <= min(i, e) and t[e - n] == words[i - n]:
                n += 1
            if n:
                out[k, e] = n
    return out


def test_matching_statistics_equal_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        some = lambda n, of: [rng.choice(of) for _ in range(n)]
        templates = [some(rng.randint(1, 9), [b"a", b"b", b"c"]) for _ in range(4)]
        phrases = [some(rng.randint(1, 3), [b"a", b"b"]) for _ in range(2)]
        auto = SuffixAutomaton(templates, phrases)
        words = some(40, [b"a", b"b", b"c", b"x"])
        got = {where: (state, length) for where, state, length in auto.statistics(words)}
        inside = {tuple(t[i:j]) for t in templates + phrases for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        for i in range(len(words)):
            longest = max([n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in inside], default=0)
            assert got.get(i, (0, 0))[1] == longest
            if longest:
                common = common_suffixes(templates, words, i)
                state = auto.states[got[i][0]]
                assert {**dict.fromkeys(state.ends, longest), **dict(state.suffixes)} == common


def best_chain(matches, max_gap):
    """The largest cover of a chain that ends with each match, by trying every chain."""

    def ending(m):
        covers = [m[2]]
        for p in matches:
            fresh = min(m[2], m[0] - p[0], m[1] - p[1])
            if fresh > 0 and m[0] - fresh - p[0] <= max_gap:
                covers.append(ending(p) + fresh)
        return max(covers)

    return max(map(ending, matches))


def test_chains_equal_brute_force():
    rng = random.Random(11)
    letters = "a b c d e f g".split()
    chained = 0
    for _ in range(300):
        templates = [(f"t{k}", " ".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))) for k in range(3)]
        templates.append(("nested", " ".join(templates[0][1].split()[1:4])))
        scanner = LicenseScanner(templates, (), min_match=2, max_gap=2, min_cover=0.5)
        text = " ".join(rng.choice([t for _, t in templates] + letters + ["x"]) for _ in range(5))
        words = words_of(text.encode())
        split = [words_of(t.encode()) for _, t in templates]
        want = {}
        for i in range(len(words)):
            after = common_suffixes(split, words, i + 1) if i + 1 < len(words) else {}
            for (k, e), n in common_suffixes(split, words, i).items():
                if n >= 2 and (k, e + 1) not in after:
                    want.setdefault(k, []).append((i, e, n))
        got = scanner.find(words)[1]
        assert {k: sorted((m.last, m.end, m.length) for m in ms) for k, ms in got.items()} == {k: sorted(ms) for k, ms in want.items()}
        for k, ms in got.items():
            chains = scanner.chains(ms)
            assert max(c for c, *_ in chains) == best_chain(want[k], 2)
            apart = disjoint(chains)
            assert set(apart) <= set(chains) and max(c for c, *_ in apart) == max(c for c, *_ in chains)
            assert all(a[2] < b[1] or b[2] < a[1] for i, a in enumerate(apart) for b in apart[:i])
            assert all(any(a[1] <= c[2] and c[1] <= a[2] and a[0] >= c[0] for a in apart) for c in chains)
            chained += len(apart) < len(ms)
        cover = max([best_chain(ms, 2) / len(split[k]) for k, ms in want.items()], default=0.0)
        assert abs(scanner.scan(text.encode())[3] - cover) < 1e-12 and cover <= 1
    assert chained > 50


def test_words_out_of_order_do_not_end_a_chain():
    scanner = LicenseScanner()
    for label, text in TEMPLATES:
        words = text.split()
        if len(words) > 10:
            half = len(words) // 2
            torn = " ".join(words[:half] + words[:3] + words[half:])
            assert any(s[2] == label and s[3] == 1.0 for s in scanner.scan(torn.encode())[2]), label


def test_long_repeats_stay_fast():
    text = ("the terms of the license and the terms of the " * 4000).encode()
    n, _, _, cover = LicenseScanner().scan(text)
    assert n == 40_000 and 0 < cover < 0.5


def base_brute(text):
    words = words_of((text or "").encode())
    out = []
    for phrase, label in BASE_PHRASES:
        p = phrase.encode().split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_base_places_equal_brute_force(spark, hard, sf_dir):
    rng = random.Random(5)
    parts = "gnu general public license apache mit cc by the MIT, License;".split()
    rows = [(i, " ".join(rng.choice(parts) for _ in range(30))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").union(hard)
    frame = frame.union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    for r in scan_licenses(frame).select("text", "licenses.*").collect():
        assert (r.n_words, [(b["first"], b["label"]) for b in r.base]) == base_brute(r.text)


def test_every_template_is_covered_whole_and_with_gaps():
    scanner = LicenseScanner()
    for label, text in TEMPLATES:
        words = text.split()
        _, _, spans, _ = scanner.scan(f"before it {text} after".encode())
        assert (2, 2 + len(words_of(text.encode())), label, 1.0) in spans
        if len(words) > 10:
            gap = " ".join(words[:5] + ["zzz"] + words[5:])
            assert any(s[2] == label and s[3] > 0.99 for s in scanner.scan(gap.encode())[2])
            far = " ".join(words[:5] + ["zzz"] * 9 + words[5:])
            assert not any(s[2] == label and s[3] > 0.99 for s in scanner.scan(far.encode())[2])


def test_empty_and_clashes(empty, clashing):
    assert scan_licenses(empty).count() == 0
    assert scan_licenses(clashing).where("size(licenses.spans) > 0").count() == 0

"""Corpus operators against brute force on small tables with every odd row: nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote, unquote

import numpy as np
import public_tokenizers
import pytest
import xxhash

from loomgrid.llm.decontaminate import cuts, drop_leaks, leaks
from loomgrid.llm.exact_dedup import exact_duplicates
from loomgrid.llm.mixing import mix_sources
from loomgrid.llm.secrets import Layer, _collapsed, find_secrets, secret_spans
from loomgrid.llm.sharding import stratified_shards
from loomgrid.llm.simhash import allocate, fingerprint, masks, near_duplicates, verified_duplicates
from loomgrid.llm.token_counts import TrieCounter, piece_scores, token_counts
from loomgrid.llm.token_files import token_table
from loomgrid.llm.toxicity import SLOPES, calibrate, class_prior, drop_toxic, toxicity, train_linear
from loomgrid.llm.url_filter import judge_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size string, h string, part string, u string, grp string"
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


def frame(spark, rows):
    """Rows of (doc_id, text, source), with more columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, None, s, 0, 7, "r", "s", "h", "p", "u", "g") for d, t, s in rows], SCHEMA)


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    rows = [(i, t, f"src{i % 3 if rng.random() < 0.7 else 0}") for i, t in enumerate(texts)]
    near = texts[3].split()
    near[len(near) // 2 :] = near[len(near) // 2 :] + ["abc"]
    rows += [
        (200, texts[0], "src0"),
        (201, texts[0], None),
        (202, None, None),
        (203, "", "src9"),
        (203, "", "src9"),
        (204, " \t\n", "src1"),
        (None, texts[1], "src1"),
        (None, None, None),
        (205, " ".join(near), "src1"),
        (206, " ".join(rng.choice(words) for _ in range(6000)), "src2"),
        (207, "one", "src2"),
    ]
    return rows


ROWS = corpus()


def test_exact_dedup(spark):
    groups = defaultdict(list)
    for d, t, _ in ROWS:
        groups[t or ""].append(d)
    for keep, pick in (("largest", max), ("smallest", min)):
        out = exact_duplicates(frame(spark, ROWS), keep=keep).collect()
        assert Counter(r["id"] for r in out) == Counter(d for d, _, _ in ROWS)
        kept = Counter()
        for r in out:
            ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r["digest"])
            assert r["group_size"] == len(ids)
            known = [i for i in ids if i is not None]
            assert r["keep_id"] == (pick(known) if known else None)
            kept[r["digest"]] += r["kept"]
            assert not r["kept"] or r["id"] == r["keep_id"]
        assert set(kept.values()) == {1}
    assert exact_duplicates(frame(spark, [])).count() == 0


def test_sharding(spark):
    k = 7
    out = stratified_shards(frame(spark, ROWS), k).collect()
    assert Counter(r["id"] for r in out) == Counter(d for d, _, _ in ROWS)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(k)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(k):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sizes[shard]))
    for source in {s for _, _, s in ROWS}:
        per = Counter(r["shard"] for r in out if r["source"] == source)
        n = sum(per.values())
        assert all(n // k - 1 <= per[s] <= -(-n // k) + 1 for s in range(k))
    text = {d: t for d, t, _ in ROWS if d is not None}
    for r in out:
        if r["id"] is not None:
            data = (text[r["id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    again = stratified_shards(frame(spark, ROWS).repartition(3), k).collect()
    place = lambda rows: sorted((r["id"], r["shard"], r["slot"]) for r in rows if r["id"] is not None and r["id"] != 203)
    assert [p[0] for p in place(again)] == [p[0] for p in place(out)]
    # A brute-force order: the rank in a seeded shuffle of each source, then the fractional rank.
    clean = [r for r in ROWS if r[0] is not None and r[0] != 203]
    by_source = defaultdict(list)
    for d, _, s in clean:
        by_source[s].append((hashlib.md5(f"17:{d}".encode()).hexdigest(), d))
    order = sorted(((2 * i + 1) / (2 * len(v)), "null" if s is None else f"={s}", d) for s, v in by_source.items() for i, (_, d) in enumerate(sorted(v)))
    want = {d: (i * k // len(order)) for i, (_, _, d) in enumerate(order)}
    assert {r["id"]: r["shard"] for r in stratified_shards(frame(spark, clean), k).collect()} == want
    assert stratified_shards(frame(spark, []), k).count() == 0
    assert sorted(r["shard"] for r in stratified_shards(frame(spark, ROWS[:2]), 5).collect()) == [0, 2]


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(spark):
    rows = ROWS + [(300 + i, "a b c", "tiny") for i in range(2)] + [(310, "", "void")]
    out = mix_sources(frame(spark, rows), (5, 2, 1)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    sizes.setdefault("void", 0)
    targets = brute_targets(sizes)
    source = {d: s for d, _, s in rows}
    taken = Counter()
    for r in out:
        if r["id"] is not None:
            assert r["target"] == pytest.approx(targets[source[r["id"]]], abs=1e-6)
            assert r["source_size"] == sizes[source[r["id"]]]
        assert 0 <= r["times"] <= 3
    assert Counter((r["id"], r["size"]) for r in out) == Counter((d, count(t)) for d, t, _ in rows)
    largest = max(r["size"] for r in out)
    for r in out:
        taken[r["target"]] += r["times"] * r["size"]
    for target, words in taken.items():
        assert abs(words - target) <= largest
    again = {(r["id"], r["size"]): r["times"] for r in mix_sources(frame(spark, rows).repartition(5), (5, 2, 1)).collect()}
    assert again == {(r["id"], r["size"]): r["times"] for r in out}
    assert mix_sources(frame(spark, []), (5, 2, 1)).count() == 0
    assert all(r["times"] == 0 for r in mix_sources(frame(spark, [(1, None, "a"), (2, "", None)]), (5, 2, 1)).collect())


def test_token_files(spark):
    from tokenizers import Tokenizer

    rows = ROWS + [(400, "a  b\n\n x<|endoftext|> don't.  ", "x"), (401, "漢字 é́ x1 \x1c b", "x")]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    out = {r["id"]: r for r in token_table(frame(spark, rows), TOKENIZER, rows_per_file=20).collect() if r["id"] is not None}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for d, t, _ in order:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        if d is not None and d != 203:
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
            assert (out[d]["start"], out[d]["n_tokens"], out[d]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)
    assert token_table(frame(spark, rows), TOKENIZER, rows_per_file=20).count() == len(rows)
    assert token_table(frame(spark, []), TOKENIZER).count() == 0


def brute_fingerprint(text, width=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def variants(seed, n, copies):
    """Texts with near copies, so that fingerprints differ by few bits."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(rng.randint(30, 200))]
        out.append(" ".join(words))
        for _ in range(copies):
            other = list(words)
            for _ in range(rng.randint(1, 4)):
                other[rng.randrange(len(other))] = "zz" + str(rng.randint(0, 99))
            out.append(" ".join(other))
    return out


def test_fingerprint():
    for t in [None, "", " ", "One", "A b C d É e", *[r[1] for r in ROWS[:40]]]:
        assert fingerprint(t) & (2**64 - 1) == brute_fingerprint(t)


@pytest.mark.parametrize("crowd", [None, 1])
def test_near_duplicates(spark, crowd, monkeypatch):
    import loomgrid.llm.simhash as module

    whole = module.fingerprint_links
    monkeypatch.setattr(module, "fingerprint_links", lambda nodes, radius: whole(nodes, radius, block=16, crowd=crowd))
    rows = ROWS + [(1000 + i, t, "v") for i, t in enumerate(variants(3, 6, 25))]
    fps = {d: brute_fingerprint(t) for d, t, _ in rows if d is not None}
    distinct = sorted(set(brute_fingerprint(t) for _, t, _ in rows))
    root = components(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 4])
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(d, least.get(root[f], d))
    out = near_duplicates(frame(spark, rows)).collect()
    assert Counter(r["id"] for r in out) == Counter(d for d, _, _ in rows)
    assert {(r["id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in out if r["id"] is not None} == {(d, f, least[root[f]]) for d, f in fps.items()}
    assert near_duplicates(frame(spark, [])).count() == 0


def test_verified_duplicates(spark):
    rows = [(i, t, "v") for i, t in enumerate(variants(8, 8, 6))] + [(900, None, "x"), (901, "", "x"), (902, "only three words", "x"), (None, "only three words", "x")]
    bags = {d: set(brute_bag(t)) for d, t, _ in rows if d is not None}
    like = lambda a, b: (not a and not b) or len(a & b) >= 0.8 * len(a | b) > 0
    out = {r["id"]: r["leader"] for r in verified_duplicates(frame(spark, rows)).collect()}
    stay = set(bags) - set(out)
    for d, leader in out.items():
        assert leader in stay and like(bags[d], bags[leader])
    missed = [(a, b) for a in stay for b in stay if a < b and like(bags[a], bags[b])]
    assert len(missed) <= 1
    assert 901 in out and out[901] == 900
    assert verified_duplicates(frame(spark, [])).count() == 0


def edited(rng, words, similarity, block):
    """A text whose Jaccard similarity to ``words`` is at ``similarity`` or just above, by a block or by scattered words."""
    bag = set(brute_bag(" ".join(words)))
    like = lambda w: len(bag & (b := set(brute_bag(" ".join(w))))) / len(bag | b)
    out, at = list(words), rng.sample(range(len(words)), len(words))
    while True:
        other = list(out)
        if block:
            other.append(f"n{rng.random()}")
        else:
            other[at.pop()] = f"n{rng.random()}"
        if like(other) < similarity:
            return " ".join(out)
        out = other


def test_verified_duplicates_at_the_limit(spark):
    """No pair is missed, whether a block was appended or words were changed, band by band; unlike pairs stay."""
    rng, rows, pairs = random.Random(4), [], {}
    for block in (True, False):
        for low, high in ((0.8, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 0.95)):
            for _ in range(25):
                words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 400))]
                rows += [(len(rows), " ".join(words), "v"), (len(rows) + 1, edited(rng, words, low, block), "v")]
                pairs[len(rows) - 2] = (block, low, high)
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(5000 + k, f"{passage} " + " ".join(f"w{rng.randrange(5000)}" for _ in range(40)), "v") for k in range(60)]
    gone = {r["id"]: r["leader"] for r in verified_duplicates(frame(spark, rows)).collect()}
    bags = {d: set(brute_bag(t)) for d, t, _ in rows}
    missed = Counter(band for d, band in pairs.items() if len(bags[d] & bags[d + 1]) >= 0.8 * len(bags[d] | bags[d + 1]) and gone.get(d + 1) != d)
    assert not missed and set(gone) == {d + 1 for d in pairs}


def brute_bag(text, width=5):
    words = (text or "").lower().split()
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def test_threshold_allocation():
    costs = [[0, 9, 20, 50, 90, 200], [0, 1, 2, 3, 90, 200], [0, 5, 9, 30, 90, 200]]
    best = allocate(costs, 4)
    assert sum(best) == 4 - 3 + 1
    every = [(a, b, c) for a in range(6) for b in range(6) for c in range(6) if a + b + c == 5]
    assert sum(costs[i][t + 1] for i, t in enumerate(best)) == min(sum(costs[i][k] for i, k in enumerate(x)) for x in every)
    assert sorted(masks(5, 2)) == sorted(m for m in range(32) if m.bit_count() <= 2)


def brute_leaks(rows, items, width=5, level=0.8):
    normal = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for d, t, _ in rows:
        words = normal(t)
        for i, text in items:
            of = normal(text)
            k = min(width, len(of))
            if not of or len(words) < k:
                continue
            bag = Counter(tuple(of[j : j + k]) for j in range(len(of) - k + 1))
            for s in range(max(1, len(words) - len(of) + 1)):
                window = words[s : s + len(of)]
                got = Counter(tuple(window[j : j + k]) for j in range(len(window) - k + 1))
                both = sum((bag & got).values())
                near = both / (sum(bag.values()) + sum(got.values()) - both)
                if near >= level - 1e-9:
                    out[d, i] = max(near, out.get((d, i), 0))
    return out


@pytest.mark.parametrize("max_marks", [20_000, 0])
def test_leaks(spark, max_marks, monkeypatch):
    monkeypatch.setattr("loomgrid.llm.decontaminate.MAX_MARKS", max_marks)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 30, 30, 45, 60, 90, 30])]
    items += [(20, None), (21, ""), (22, "same same same same same same same same"), (23, items[4][1])]
    rows = []
    for i, (_, text) in enumerate(items[:10] + [items[12]]):
        of = text.split()
        for edit in range(4):
            body = list(of)
            if edit == 1 and len(of) > 20:
                body[0] = "new"
            if edit == 2 and len(of) > 20:
                body[len(of) // 2] = "new"
            if edit == 3:
                del body[len(of) // 2 : len(of) // 2 + 1]
            pad = [word() for _ in range(rng.randint(0, 60))]
            rows.append((100 * i + edit, " ".join([*pad, *body, *pad[::-1]]).capitalize().replace(" ", ",  ", 3), "s"))
        rows.append((100 * i + 50, " ".join(of[: int(0.95 * len(of))]), "s"))
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, "same " * 400, "s"), (5003, " ".join(word() for _ in range(3000)) + " " + items[8][1], "s")]
    want = brute_leaks(rows, items)
    table = spark.createDataFrame(items, "item_id int, text string")
    found = {(r["id"], r["item_id"]): r["similarity"] for r in leaks(frame(spark, rows + rows[:3]), table).collect()}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k]) for k in want)
    kept = sorted(r["doc_id"] for r in drop_leaks(frame(spark, rows), table).collect())
    assert kept == sorted(d for d, _, _ in rows if d not in {k[0] for k in want})
    assert drop_leaks(frame(spark, rows), table).columns == frame(spark, rows).columns
    assert leaks(frame(spark, []), table).count() == 0
    assert leaks(frame(spark, rows), table.limit(0)).count() == 0
    assert leaks(frame(spark, [(None, items[4][1], "s")]), table).count() == 2


def test_token_counts(spark):
    pieces = piece_scores(PIECES)

    def brute(word):
        best = {0: (0.0, 0)}
        low = min(pieces.values()) - 10
        for end in range(1, len(word) + 1):
            s, n = best[end - 1]
            options = [(s + low, n + len(word[end - 1].encode()))]
            options += [(best[a][0] + pieces[word[a:end]], best[a][1] + 1) for a in range(end) if word[a:end] in pieces]
            best[end] = max(options, key=lambda o: (o[0], -o[1]))
        return best[len(word)][1]

    rows = ROWS + [(500, "漢字 don't stop believing " + "x" * 300, "s")]
    want = sorted((d is None, d or 0, sum(brute("▁" + w) for w in (t or "").split())) for d, t, _ in rows)
    out = token_counts(frame(spark, rows), PIECES, batch_chars=500).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["n_tokens"]) for r in out) == want
    assert token_counts(frame(spark, []), PIECES).count() == 0
    counter = TrieCounter(pieces)
    counter.learn({"▁the", "▁then", "▁there"})
    assert counter.nodes == len("▁the") + len("n") + len("re")


def test_toxicity(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    bad = ["vile" + "".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(40)]
    rows, labels = [], []
    for i in range(1500):
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            body[rng.randrange(len(body))] = rng.choice(bad)
        rows.append((i, " ".join(body), "s"))
        if i % 2:
            labels.append((i, int(toxic)))
    rows += [(5000, None, "s"), (5001, "", "s"), (None, "vileabc", "s"), (None, None, None)]
    labels += [(None, 1), (3, None), (5, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity(frame(spark, rows), marks).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    for r in out:
        assert r["held_out"] == (r["id"] is not None and zlib.crc32(str(r["id"]).encode()) % 4 == 2)
    tests = [r for r in out if r["held_out"] and r["id"] < 1500]
    assert sum(r["predicted"] == (r["id"] % 5 == 0) for r in tests) / len(tests) > 0.95
    kept = drop_toxic(frame(spark, rows), marks)
    assert kept.columns == frame(spark, rows).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["id"] for r in out if not r["predicted"])
    assert {r["predicted"] for r in toxicity(frame(spark, rows), marks.limit(0)).collect()} == {0}
    assert toxicity(frame(spark, []), marks).count() == 0


def test_url_filter(spark):
    rules = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
    urls = [
        "http://a.Example.com/en/1?x#y", "https://www.example.com/en/2", "http://x.www.example.com/en/3", "http://example.com/fr", "http://b.net/es/4",
        "http://b.net/es", "http://b.org/fr/5", "ftp://notexample.com/en/", "http://b.com?q", "http://B.COM#f", "no scheme", "", None, "http://", "://h/p", "http://é.net/fr/ü?", "http://b.org/" + "x" * 20000,
        *[f"http://s{i}.{h}.example.{t}/{p}/{i}" for i in range(30) for h in ("m", "blog") for t in ("com", "net", "org") for p in ("en", "fr", "es")],
    ]
    pages = spark.createDataFrame([(i, u, "<html>", "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, path string, rule string")
    out = {r["id"]: r for r in judge_urls(pages, rules).collect()}
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        assert (out[i]["host"], out[i]["path"]) == (host, path)
        if fits:
            assert (out[i]["rule"], out[i]["verdict"]) == max(fits)[1:]
        else:
            assert out[i]["rule"] is None and out[i]["verdict"] == ("block" if out[i]["score"] >= 0.5 else "allow")
    # The model ranks the rules' own blocked URLs over the allowed ones.
    right = [(r["score"] >= 0.5) == (r["verdict"] == "block") for r in out.values() if r["rule"]]
    assert sum(right) / len(right) > 0.9
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, ()).collect()} == {"allow"}


def brute_base(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def test_secrets(spark):
    rng = random.Random(2)
    secret = "password = hunter2hunter2"
    b64 = base64.b64encode(secret.encode()).decode()
    texts = [
        None, "", secret, f"é {secret} and API_KEY:'abc' token=\"abcdef\" apikey=ſecret", "AKIA" + "B" * 16 + " AKIA123", "x" * 3 + "a1" * 20 + " " + "a" * 23,
        "%70assword%20%3D%20hunter2hunter2 tail", "%2570assword=abcdefgh", r"pre password=abcdefg", r"\x70asswd: qwertyu \U0001F600 \u{74}oken=abcdefg 😀 \ud83d",
        f"see {b64} end", "see " + base64.b64encode(b64.encode()).decode(), "z " + base64.b64encode(gzip.compress(secret.encode())).decode() + " z", "z " + base64.b64encode(zlib.compress(secret.encode() * 30)).decode(),
        "%" * 50 + " 100% %zz %C3%28 %", "=" * 40 + "A" * 41, "ſecret=abcdefgh toKen=abcdefgh",
    ]
    for _ in range(200):
        texts.append("".join(rng.choice(["a", "f", "9", " ", "=", "token", "Secret", "AKIA", "Z", '"', "%41", "\\u0041", "é", ":"]) for _ in range(rng.randint(1, 60))))
    for t in texts:
        base, spans = find_secrets(t)
        assert base == brute_base(t or "")
        assert set(base) <= set(spans)
        assert all(0 <= a < b <= len(t) for _, a, b in spans)
    span = lambda t: find_secrets(t)[1]
    assert span(texts[6])[0] == ("assign", 0, len("%70assword%20%3D%20hunter2hunter2"))
    assert ("assign", 0, len(texts[7])) in span(texts[7])
    assert ("assign", 4, len(texts[8])) in span(texts[8])
    assert [s[0] for s in span(texts[9])] == ["assign", "assign"]
    assert span(texts[10]) == [("assign", 4, 4 + len(b64.rstrip("=")))]
    assert [s[0] for s in span(texts[11])] == ["assign"]
    assert [s[0] for s in span(texts[12])] == ["assign"] and [s[0] for s in span(texts[13])] == ["assign"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, secret, None)]
    out = secret_spans(frame(spark, rows)).collect()
    for r in out:
        if r["id"] is not None:
            base = brute_base(texts[r["id"]] or "")
            assert r["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
    assert len(out) == len(rows) and secret_spans(frame(spark, [])).count() == 0


def test_secrets_in_joined_runs():
    """An encoded secret is found after a path or a name, in either alphabet, and beside unprintable characters."""
    secret = "password=hunter2secretvalue"
    code = base64.b64encode(secret.encode()).decode()
    packed = base64.b64encode(gzip.compress(secret.encode())).decode().rstrip("=")
    for before in ("token ", "data:text/plain;base64,", "https://h.example/d/", "files/", "id-", "a_", "x", "ab", "abc", "long_name-of/some_path-"):
        assert ("assign", len(before), len(before) + len(code.rstrip("="))) in find_secrets(before + code)[1]
        assert ("assign", len(before), len(before) + len(packed)) in find_secrets(before + packed)[1]
    for odd in ("\u00a0", "\u3000", "\u200b", "\ufeff", "\x07"):
        for encode in (base64.b64encode, base64.urlsafe_b64encode):
            text = "see " + encode(f"some prose{odd} {secret} and {odd}more".encode()).decode()
            assert [k for k, _, _ in find_secrets(text)[1]] == ["assign"]


def test_secrets_in_long_and_joined_parts():
    """All members of a compressed part are scanned, and all of it beyond 64 MB, also behind a cut character."""
    secret, plain = b"password=hunter2secretvalue", b"nothing to see here, only prose"
    for pack in (gzip.compress, bz2.compress, lzma.compress):
        text = "see " + base64.b64encode(pack(plain) + pack(secret)).decode()
        assert ("assign", 4, len(text)) in find_secrets(text)[1]
    text = "see " + base64.b64encode(gzip.compress(gzip.compress("é".encode() * (33 << 20) + b" " + secret, 1), 1)).decode()
    assert [k for k, _, _ in find_secrets(text)[1]] == ["assign"]


def brute_layers(text, depth=6):
    """Texts behind a whole text that is encoded in one known way a layer, by trying every way on the whole of it."""
    found, work = {text}, [(text, 0)]
    while work:
        now, k = work.pop()
        ways = [unquote(now)]
        try:
            ways.append(re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), now))
            data = base64.b64decode(now, validate=True)
            for way in (lambda d: d, gzip.decompress, zlib.decompress, bz2.decompress, lzma.decompress, lambda d: zlib.decompress(d, -15)):
                try:
                    got = way(data)
                    ways += [got.decode("utf-16-le" if got[1:2] == b"\0" else "utf-8")]
                except (OSError, zlib.error, lzma.LZMAError, UnicodeDecodeError, EOFError):
                    pass
        except ValueError:
            pass
        for other in ways:
            if other not in found and k < depth:
                found.add(other)
                work.append((other, k + 1))
    return found


def test_secrets_in_random_nests():
    """Layers put on by chance: whatever the whole text decodes to shows its secrets, and only those, at the right place."""
    rng = random.Random(11)
    deflate = lambda b: (c := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(b) + c.flush()
    coats = [
        lambda t: base64.b64encode(t.encode()).decode(),
        lambda t: "".join(f"%{b:02X}" for b in t.encode()),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        lambda t: base64.b64encode(t.encode("utf-16-le")).decode(),
        *[lambda t, p=p: base64.b64encode(p(t.encode())).decode() for p in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, deflate)],
    ]
    for _ in range(150):
        secret = rng.choice(["password=hunter2value", "token: abcdef123456", "AKIA" + "QWERTY7890" * 2, "plain prose and no more"])
        coded = f"{rng.choice(['', 'é '])}{secret}"
        for _ in range(rng.randint(1, 3)):
            coded = rng.choice(coats)(coded)
        kinds = {k for t in brute_layers(coded) for k, _, _ in brute_base(t) if k != "hex"}
        before = rng.choice(["", "see: ", "é, "])
        spans = [s for s in find_secrets(f"{before}{coded}, end")[1] if s[0] != "hex"]
        assert kinds == {k for k, _, _ in spans}, (secret, coded)
        assert all(len(before) <= a < b <= len(before) + len(coded) for _, a, b in spans)


def test_secrets_behind_odd_encodings():
    secret = "password=hunter2secretvalue"
    code = lambda b: base64.b64encode(b).decode()
    kinds = lambda t: [k for k, _, _ in find_secrets(t)[1] if k == "assign"]
    lines = code(b"some prose " + secret.encode())
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = code(deflate.compress(secret.encode()) + deflate.flush())
    assert kinds("see " + code(b"abc\0" + secret.encode())) == ["assign"]
    assert kinds("see " + code(secret.encode("utf-16"))) and kinds("see " + code(secret.encode("utf-16-be")))
    assert kinds("see " + raw) == ["assign"] == kinds("https://h.example/d/" + raw)
    assert find_secrets(f"see {lines[:24]}\r\n  {lines[24:]} end")[1] == [("assign", 18, 4 + len(lines.rstrip("=")) + 4)]
    assert find_secrets("%FF%70assword=hunter2value")[1] == [("assign", 3, 26)]
    assert kinds("z " + quote(gzip.compress(secret.encode()))) == ["assign"]
    assert kinds("/data/" + code(secret.encode())) == ["assign"] == kinds("cfg_" + code(secret.encode()))


def test_secrets_in_deep_escapes():
    """The work on nested escapes grows with their length; the decoded text is that of layer after layer."""
    for n in (5, 40, 3000):
        for text in ("%" + "25" * n + "70assword=hunter2value", "%5cu0025" + "5cu0025" * n + "70assword=hunter2value", "\\u005c" + "u005c" * n + "u0070assword=hunter2value"):
            began = time.process_time()
            assert ("assign", 0, len(text)) in find_secrets(text)[1]
            assert time.process_time() - began < 1
    for text in ("%E2%82%AC" * 3, "%2545", "%25E2%2582%25AC x", r"\ud83d\ude00 \ud83d x", "%C3x%A9%C3%A9", r"\u{1F600}%zz\x41", "a%b%" * 9):
        layer = text
        while True:
            step = re.sub(r"\\u\{([0-9A-F]+)\}|\\x([0-9a-f]{2})", lambda m: chr(int(m[1] or m[2], 16)), layer)
            step = re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"), step)
            step = re.sub("[\udc80-\udcff]", lambda m: f"%{ord(m[0]) - 0xDC00:02X}", step)
            step = step.replace(r"\ud83d\ude00", "😀")
            if step == layer:
                break
            layer = step
        found = _collapsed(Layer(text))
        assert found.text == layer and len(found.first) == len(found.last) == len(layer)


def test_blocks_guarantee_the_radius():
    """Fingerprints within the radius are within the threshold of some block, for any spread of the differing bits."""
    rng = random.Random(6)
    for radius in (0, 3, 5, 6, 21, 40):
        found = cuts(radius)
        assert [a + w for a, w, _ in found] == [a for a, _, _ in found[1:]] + [64] and found[0][0] == 0
        assert sum(max(t, -1) + 1 for _, _, t in found) >= radius + 1
        for _ in range(500):
            apart = sum(1 << b for b in rng.sample(range(64), radius))
            assert any((apart >> a & (1 << w) - 1).bit_count() <= t for a, w, t in found)


def test_toxicity_learns_from_positives_and_unlabelled_only(spark):
    """Confirmed negatives change nothing; prior, calibration and the classifier's gradient are held against plain versions."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*rng.choices(words, k=20), *(["vile"] if i % 6 == 0 else [])]), "s") for i in range(800)]
    marks = [(i, int(i % 6 == 0)) for i in range(0, 800, 2)]
    score = lambda m: {r["id"]: r["score"] for r in toxicity(frame(spark, rows), spark.createDataFrame(m, "doc_id long, toxic int")).collect()}
    assert score(marks) == score([m for m in marks if m[1]])

    make = np.random.default_rng(5)
    margin = np.concatenate([make.normal(4, 1, 400), make.normal(4, 1, 300), make.normal(-4, 1, 1700)])
    positive = np.arange(len(margin)) < 400
    prior = class_prior(margin, positive)
    assert 0.14 < prior < 0.19
    slope, more = calibrate(margin, positive, 0.15)
    chance = lambda a, b, x: 1 / (1 + np.exp(-(a * x + b)))
    assert chance(slope, more, margin[~positive]).mean() == pytest.approx(0.15, abs=1e-6)

    def risk(a, b):
        p, u = chance(a, b, margin[positive]), chance(a, b, margin[~positive])
        return -0.15 * np.log(p).mean() + max(0.0, -np.log(1 - u + 1e-300).mean() + 0.15 * np.log(1 - p + 1e-300).mean())

    for a in SLOPES:
        least = min(np.linspace(-30, 30, 6001), key=lambda b: abs(chance(a, b, margin[~positive]).mean() - 0.15))
        assert risk(slope, more) <= risk(a, least) + 1e-3

    # One step of the classifier goes down the slope of the non-negative risk, found by differences.
    bags, labels, pi = [[0], [0, 1], [1], [2], [], [1, 2]], np.array([True, True, False, False, False, False]), 0.3

    def pu(theta):
        m = np.array([theta[b].sum() + theta[-1] for b in bags])
        plus, minus = np.log1p(np.exp(-m)), np.log1p(np.exp(m))
        rest = minus[~labels].mean() - pi * minus[labels].mean()
        return pi * plus[labels].mean() + rest if rest >= 0 else -rest

    start = np.array([0.0, 0.0, 0.0, np.log(pi / (1 - pi))])
    steps = np.array([(pu(start + e) - pu(start - e)) / 2e-6 for e in 1e-6 * np.eye(4)])
    owner, slots = (np.array(x) for x in zip(*[(i, f) for i, b in enumerate(bags) for f in b]))
    w, b = train_linear(owner, slots, labels, 3, pi, steps=1, rate=1.0, decay=0.0)
    assert np.append(w, b) == pytest.approx(start - np.sign(steps), abs=1e-3)


def test_exact_dedup_takes_any_ids(spark):
    """Ids that cannot be negated: strings, and the smallest long."""
    rows = [("b", "x"), ("a", "x"), (None, "x"), ("c", "y")]
    for keep, want in (("smallest", {"a", "c"}), ("largest", {"b", "c"})):
        out = exact_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), keep=keep).collect()
        assert {r["id"] for r in out if r["kept"]} == want and len(out) == 4
    least = -(2**63)
    out = exact_duplicates(spark.createDataFrame([(least, "x"), (0, "x")], "doc_id long, text string")).collect()
    assert {r["keep_id"] for r in out} == {least}

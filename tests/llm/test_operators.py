"""Operators against brute force, and their defined results on nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
import regex
import tiktoken
import xxhash

from spanweave.llm import bpe, chat, decontaminate, language, media, quality, secrets, simhash, substrings, unigram
from spanweave.llm.queries import QUERIES, VOCABULARY

WORDS = "the and of stone river light wind table under over blue green seven eleven morning evening paper glass".split()
#: Columns that clash with names that operators use inside.
EXTRA = "fp long, chunk string, shard string, rank int, `__rank__` int, host string, words string, SLICE int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def corpus():
    rng = random.Random(3)
    shared = sentence(rng, 60)
    texts = [sentence(rng, rng.randint(0, 80)) for _ in range(30)]
    texts += [texts[0], texts[0], None, None, "", "  \n\t ", "one", "a b c", "é" * 50, "x " * 3000, shared, f"{shared} tail words", f"head x {shared}", sentence(rng, 4000), "A" * 20000, "İ\x1f zero\x0bwidth  Ünï"]
    texts += [" ".join([*shared.split()[:40], "changed", *shared.split()[41:]])]
    return list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(i, t, "en", "src", None, 1, "c", None, 2, 3, "h", None, 5) for i, t in rows]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return repr(tuple(r))


# -- substring dedup ---------------------------------------------------------------------------------------------


def expected_windows(rows, size):
    words = [(i if i is not None else 1 << 62, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            first[window] = min(first.get(window, i), i)
    out = []
    for (i, w), (real, _) in zip(words, rows):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((real, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [13, 5])
def test_substrings(docs, rows, size, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 30_000)
    got = sorted((tuple(r) for r in substrings.drop_repeats(docs, window=size).collect()), key=repr)
    assert got == expected_windows(rows, size)
    assert sum(r[2] for r in got) > 0


def test_substrings_empty(nothing):
    assert substrings.drop_repeats(nothing).collect() == []


# -- simhash -----------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(points, radius):
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in points:
        for b in points:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def test_simhash(docs, rows):
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs).collect()), key=repr)
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    roots = plain_components({p for _, p in prints}, 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    assert got == sorted(((i, p, least.get(roots[p])) for i, p in prints), key=repr)


@pytest.mark.parametrize("projections, most", [(2, 1 << 32), (3, 1 << 32), (3, 50), (5, 1 << 32), (1, 1 << 32), (1, 2000)])
def test_links_lose_none(spark, monkeypatch, projections, most):
    """Clusters, chains and single points: the components of spanning links are those of all pairs, split shards or not."""
    monkeypatch.setattr(simhash, "SHARD_PAIRS", most)
    rng = random.Random(projections)
    points = {rng.getrandbits(64) for _ in range(300)}
    for seed in list(points)[:12]:
        for _ in range(25):
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            points.add(seed)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    df = spark.createDataFrame(signed, "fp long")
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(df, 4, projections)).collect()}
    want = plain_components(points, 4)
    groups = {}
    for p, root in want.items():
        groups.setdefault(root, set()).add(p)
    mine = {}
    for p in points:
        mine.setdefault(found.get(p, p), set()).add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}


def test_keep_first(docs, rows, nothing):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    roots = plain_components({plain_fingerprint(t) for _, t in rows}, 4)
    by = {}
    for i, t in rows:
        by.setdefault(roots[plain_fingerprint(t)], []).append((i is None, i))
    assert sorted(i for i, _ in got if i is not None) == sorted(min(v)[1] for v in by.values() if min(v)[1] is not None)
    assert len(got) == len(by)
    assert simhash.keep_first(nothing).collect() == []


# -- decontamination ---------------------------------------------------------------------------------------------


def edit_distance(item, text):
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        last = row
    return min(last)


def test_matcher_is_exact():
    rng = random.Random(5)
    for _ in range(150):
        item = decontaminate.normal("".join(rng.choices("abcd ", k=rng.randint(1, 60))))
        if not item:
            continue
        letters = list(item)
        for _ in range(rng.randint(0, int(len(item) * 0.15) + 2)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        text = decontaminate.normal("".join(rng.choices("abcd ", k=30)) + "".join(letters) + "".join(rng.choices("abcd ", k=30)))
        want = edit_distance(item, text)
        got = dict(decontaminate.Matcher([(1, item)], 0.15).search(text)).get(0)
        assert got == (want if want <= int(len(item) * 0.15) else None)


def test_contamination(spark, docs, rows, nothing):
    item = rows[40][1]
    items = spark.createDataFrame([(1, item), (2, item.upper()), (3, None), (4, "  "), (None, "no such passage in any text"), (6, item.replace("stone", "stome", 1))], "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, items).collect()), key=repr)
    want = []
    for i, t in rows:
        for k, it in ((1, item), (2, item), (6, item.replace("stone", "stome", 1))):
            norm = decontaminate.normal(it)
            d = edit_distance(norm, decontaminate.normal(t)[:1500])
            if d <= int(len(norm) * 0.1):
                want.append((i, k, d, int(len(norm) * 0.1)))
    assert got == sorted(want, key=repr) and len({g[0] for g in got}) >= 4
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len({repr(g[0]) for g in got})
    assert decontaminate.contamination(nothing, items).collect() == []
    assert decontaminate.contamination(docs, items.limit(0)).collect() == []


# -- media -------------------------------------------------------------------------------------------------------


def test_media(docs, rows, nothing):
    got = media.media_columns(docs).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        png = media.to_png(payload)
        digest = hashlib.sha256(payload).hexdigest()
        want.append((i, len(raw), len(payload), digest, digest, zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), 192, len(payload) // 192, 8))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "digest", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "bit_depth")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted(want, key=repr)
    assert media.media_columns(nothing).collect() == []


def test_png_is_read_by_others():
    payload = media.padded("hello".encode() * 100)
    png = media.to_png(payload)
    assert media.from_png(png) == payload
    with pytest.raises(ValueError):
        media.from_png(png[:60] + b"?" + png[61:])


def test_windows_of_equal_linear_hash(spark):
    """Words that any polynomial hash modulo a power of two takes for equal are told apart."""
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    lead = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join([one, *lead])), (2, " ".join([other, *lead])), (3, " ".join([other, *lead])), (4, "  \t".join([one, *lead]) + "\n")]
    got = {r.doc_id: r.n_removed for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13, 4: 13}
    with pytest.raises(ValueError):
        substrings.drop_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def plain_png(data: bytes):
    """Width, height and samples by the format's own rules, apart from the module's reader."""
    import struct
    import zlib

    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + size
    width, height, depth, colour, packing, filters, lace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    assert (depth, colour, packing, filters, lace) == (8, 0, 0, 0, 0) and b"IEND" in parts
    raw = zlib.decompress(parts[b"IDAT"])
    lines = [raw[k : k + width + 1] for k in range(0, len(raw), width + 1)]
    assert len(lines) == height and all(line[0] == 0 for line in lines)
    return width, height, b"".join(line[1:] for line in lines)


def test_shards_are_read_by_tarfile(spark, docs, rows, tmp_path):
    """Shards are tar files of PNG images for any reader; the feature follows from the samples."""
    import statistics
    import tarfile

    folder = f"file://{tmp_path}/m"
    index = media.store(docs, folder)
    found = {}
    for path in (tmp_path / "m").iterdir():
        with tarfile.open(path) as tar:
            for member in tar.getmembers():
                found[path.name, member.offset_data] = (member.name, member.size, tar.extractfile(member).read())
    got = media.with_payload_columns(media.with_metadata(index, folder), folder).collect()
    assert len(got) == len(rows)
    for r in got:
        name, size, data = found[r.shard, r.offset]
        width, height, samples = plain_png(data)
        assert (r.length, r.width, r.height) == (size, width, height) and r.digest == hashlib.sha256(samples).hexdigest() and r.digest in name
        assert r.media_sha256 == hashlib.sha256(data).hexdigest()
        mean, std, _ = (part.partition("=")[2] for part in r.feature.split(";"))
        assert abs(float(mean) - statistics.fmean(samples)) < 1e-3 and abs(float(std) - statistics.pstdev(samples)) < 1e-3
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in rows:
        if i in by_id and sum(k == i for k, _ in rows) == 1:
            raw = (t or "").encode()
            payload = raw + b" " * (-len(raw) % 192 if raw else 192)
            assert by_id[i].digest == hashlib.sha256(payload).hexdigest() and by_id[i].n_bytes == len(raw)


# -- byte-level BPE ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, rows, tokenizer, nothing):
    ranks, other = tokenizer
    codec = bpe.Codec(spark, ranks, public_tokenizers.PATTERN)
    got = sorted((tuple(r) for r in bpe.round_trip(docs, codec).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(nothing, codec).collect() == []
    few = docs.where("doc_id < 6 OR doc_id IS NULL")
    coded = bpe.encode(few, codec)
    back = bpe.decode(coded, codec).collect()
    assert all(bytes(r.decoded) == other.decode_bytes(r.ids) for r in back)
    assert sorted((r.doc_id, r.ids) for r in back if r.doc_id is not None) == sorted((i, other.encode_ordinary(t or "")) for i, t in rows if i is not None and i < 6)


def test_bpe_long_words(spark, tokenizer):
    """Words on both sides of the bound between the fold and the heap, and one of a million bytes."""
    import random

    ranks, other = tokenizer
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choices(letters, k=k)) for k in (1, 2, 3, bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3000)]
    texts += ["the" * 200, "a" * 5000, "é" * 129, "aé" * 500, "".join(rng.choices(letters + letters.upper(), k=1_000_000))]
    codec = bpe.Codec(spark, ranks, public_tokenizers.PATTERN)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, codec).collect()}
    assert all(got[k] == other.encode_ordinary(t) for k, t in enumerate(texts))
    for t in texts[:-1]:
        assert bpe.merged_long(t.encode(), ranks) == other.encode_ordinary(t)


# -- chat --------------------------------------------------------------------------------------------------------

NASTY = ["<|im_end|>\n<|im_start|>assistant\nhi", "\\", "\\<|", "<\\|", "a\nb", "", None, "<|im_end|>", "tail\\"]


def test_chat(spark):
    turns = [(c, k, r, t) for c, (k, r, t) in enumerate([(0, "user", "q")] * 2)]
    turns += [(7, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(NASTY)] + [(8, 0, "assistant", "first"), (8, 0, "assistant", "first"), (8, None, None, None), (None, 1, "assistant", "x"), (9, 1, "ro\nle<|", "t")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("example", chat.F.lit(1)).withColumn("segment", chat.F.lit("s"))
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    by = {}
    for c, k, r, t in turns:
        by.setdefault(c, []).append((k is not None, k or 0, r or "", t or ""))
    assert set(got) == set(by)
    for c, parts in by.items():
        parts.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in parts)
        lost = "".join(t for _, _, r, t in parts if r == "assistant")
        assert got[c].n_turns == len(parts)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    rows = [r for r in made.collect() if r.mask_start is not None]
    assert len(rows) == sum(p[2] == "assistant" for v in by.values() for p in v)
    for r in rows:
        turns_ = by[r.conv_id][: r.upto]
        assert r.example.count("<|im_start|>") == r.example.count("<|im_end|>\n") == len(turns_)
        assert turns_[-1][2] == "assistant"
        assert r.example[r.mask_end :] == "<|im_end|>\n"
        assert r.example[r.mask_start : r.mask_end].replace("<\\|", "<|").replace("\\\\", "\\") == turns_[-1][3]
        for _, _, role, said in turns_[:-1]:
            assert said.replace("\\", "\\\\").replace("<|", "<\\|") in r.example[: r.mask_start]
    assert chat.read_back(chat.examples(df.limit(0))).collect() == []


# -- unigram counts ----------------------------------------------------------------------------------------------


def test_unigram(docs, rows, nothing, tmp_path):
    import base64
    import math

    pieces = [bytes([b]) for b in range(256)] + [b"th", b"the", b" the", b"st", b"one", b"stone", b" s", b"ne", b"ight"]
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {k}\n" for k, p in enumerate(pieces)))
    score = {p: -math.log(k + 2) for k, p in enumerate(pieces)}

    def best(word):
        ways = [(0.0, 0)]  # score, and pieces as a negative number: more is better in both
        for end in range(1, len(word) + 1):
            ways.append(max((ways[b][0] + score[word[b:end]], ways[b][1] - 1) for b in range(end) if word[b:end] in score))
        return -ways[-1][1]

    pattern = r" ?\S+|\s+"
    got = sorted((tuple(r) for r in unigram.token_counts(docs, str(path), pattern).collect()), key=repr)
    def rows_of(kept):
        return sorted(((i, len(words), sum(best(w.encode()) for w in words)) for i, t in kept for words in [regex.findall(pattern, t or "")]), key=repr)

    short = [(i, t) for i, t in rows if i is not None and all(len(w) < 300 for w in regex.findall(pattern, t or ""))]
    assert [g for g in got if g[0] in {i for i, _ in short}] == rows_of(short)
    assert len(got) == len(rows) and unigram.token_counts(nothing, str(path), pattern).collect() == []


# -- secrets -----------------------------------------------------------------------------------------------------

LEAKS = "x password = 'abcdefgh1' AKIAABCDEFGHIJKL12 token: secret: abcdefghij API_KEY=short Passwd:\"12345678\" " + "0a" * 20 + " deadbeef é AKIAX toKen=" + "f" * 40


def test_base_spans():
    base = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = [(m.start(), m.end(), "assign") for m in base.finditer(LEAKS) if len(m[2]) >= 8]
    want += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", LEAKS) if len(m[0]) >= 16]
    want += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", LEAKS) if len(m[0]) >= 32]
    assert secrets.base_spans(LEAKS) == sorted(want, key=lambda s: (s[0], secrets.KINDS.index(s[2]))) and len(want) >= 5


#: Names that are no words of the field's lexicon, values of shapes that its own lines do not spell, and lines without any.
NAMED = ["aws_secret_access_key = {}", "DB_PASS='{}'", "stripe_webhook_secret: {}", "GITHUB_TOKEN={}", "azure-storage-key = \"{}\"", "RABBITMQ_PWD: {}", "jwtSigningKey = {}", "root_passwd := '{}'", "x-vault-token: {}", "SENTRY_AUTH={}"]
HARMLESS = [
    "https://example.com/files/AbC123xYz987QwErTyUiOp", "see http://docs.site.org/api/token/intro/4fGh2KqLm9 for more", "the passage of the key author", "keyboard_layout = qwerty_international",
    "/usr/lib/python3.11/site-packages/numpy/core/multiarray.py", "max_tokens = 4096", "public_key_path = /etc/ssh/keys/id_rsa.pub", "request 550e8400-e29b-41d4-a716-446655440000 done", "version v2.14.3-rc1 of 2024-10-12",
    "https://cdn.shop.io/img/9f8A7b6C5d4E3f2A1b/large.html", "primary_key = customer_order_id", "commit 4f2a9c1 by author on main",
]


def test_secrets_under_names_outside_the_lexicon():
    rng, model = random.Random(31), secrets.trained()
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    assert not {n.split("{")[0].strip(" =:'\"").lower() for n in NAMED} & model.lexicon
    right = found = wanted = 0
    for k in range(400):
        secret = "".join(rng.choices(letters, k=rng.choice([20, 26, 32, 40])))
        secret = f"{secret[:9]}/{secret[9:17]}{rng.choice('+/-_')}{secret[17:]}" if k % 3 == 0 else secret
        head = f"{sentence(rng, 3)} {NAMED[k % len(NAMED)].split('{')[0]}"
        text = f"{head}{secret}{NAMED[k % len(NAMED)].split('}')[1]} {sentence(rng, 4)}"
        spans = secrets.all_spans(model, text)[1]
        hit = any(a <= len(head) and len(head) + len(secret) <= b for a, b, _ in spans)
        right, found, wanted = right + hit, found + max(1, len(spans)) - (not spans), wanted + 1
    assert right / wanted >= 0.9 and right / found >= 0.9
    assert [x for t in HARMLESS for x in secrets.all_spans(model, t)[1]] == []
    assert [x for t in HARMLESS for x in secrets.all_spans(model, f"{sentence(rng, 6)} {t} {sentence(rng, 6)}")[1]] == []


def test_crf_finds_held_out_secrets():
    model, found, extra, wanted = secrets.trained(), 0, 0, 0
    for words, tags in secrets.lines(99, 400):
        want, k = set(), 0
        while k < len(tags):
            if tags[k] == secrets.BEGIN:
                stop = k
                while stop + 1 < len(tags) and tags[stop + 1] == secrets.INSIDE:
                    stop += 1
                want.add((k, stop))
                k = stop
            k += 1
        got = set(model.tag(words))
        found, extra, wanted = found + len(got & want), extra + len(got - want), wanted + len(want)
    assert found / wanted > 0.85 and found / (found + extra) > 0.85


def planted(seed: int, texts: list[str]):
    """Texts with one line each that names and spells a secret unlike the field's own training lines, and its place."""
    import random

    rng = random.Random(seed)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = ["0123456789ABCDEF", low + low.upper() + digits + "+/", low.upper() + "234567", low + low.upper() + digits, low + digits]
    frames = [
        'client_secret_v2 = "{}"', "Authorization: Bearer {}", "private_key={}", "the credential is {}", "encryption_key = {}", "session_key: {}", "db_pwd={}",
        "the passphrase is {}", 'webhook_key: "{}"', "my credentials are {}", "signing_key: '{}'",
    ]
    for text in texts:
        secret = "".join(rng.choices(rng.choice(alphabets), k=rng.choice([18, 22, 28, 36, 44, 50])))
        frame = rng.choice(frames)
        words = text.split(" ")
        at = rng.randint(0, len(words))
        head = " ".join([*words[:at], frame[: frame.index("{}")]]).lstrip()
        yield head + secret + frame[frame.index("{}") + 2 :] + " " + " ".join(words[at:]), len(head), len(head) + len(secret)


def test_crf_finds_what_the_rules_miss(spark, sf_dir):
    """Secrets of other names and alphabets in whole documents: found with their bounds, and nothing in untouched ones."""
    model = secrets.trained()
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r.text]
    found = wanted = extra = 0
    for text, a, b in planted(17, texts):
        base, spans = secrets.all_spans(model, text)
        assert all(s in spans for s in base)
        if any(s[0] <= a and b <= s[1] for s in base):
            continue
        wanted += 1
        found += (a, b, "crf") in spans
        extra += sum(s[2] == "crf" and s[:2] != (a, b) for s in spans)
    assert wanted > 100 and found / wanted > 0.9 and found / (found + extra) > 0.9
    untouched = sum(s[2] == "crf" for t in texts for s in secrets.all_spans(model, t)[1])
    assert untouched <= len(texts) // 100


def test_scan_rows(spark, rows, docs, nothing):
    """Every column of every row, from the spans of its text; a text of very many spans ends soon."""
    model = secrets.trained()
    many = " ".join(f"token={k:040x}" for k in range(20_000))
    given = [*rows, (900, many), (901, LEAKS), (901, LEAKS), (902, "session_key = q8Zr2LmX0pTvW4yB7nK1 end")]
    got = sorted((tuple(r) for r in secrets.scan(spark.createDataFrame(given, "doc_id long, text string")).collect()), key=repr)
    want = []
    for key, text in given:
        base = secrets.base_spans(text or "")
        more = [s for s in secrets.crf_spans(model, text or "") if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)] if key != 900 else []
        spans = sorted(base + more, key=lambda s: (s[0], secrets.KINDS.index(s[2])))
        said = [",".join(f"{k}:{a}:{b}" for a, b, k in part) for part in (base, spans)]
        counts = [sum(s[2] == k for s in spans) for k in secrets.KINDS]
        want.append((key, *counts, hashlib.sha256(said[0].encode()).hexdigest(), said[1]))
    assert got == sorted(want, key=repr)
    assert any(r[0] == 902 and r[4] == 1 for r in got)
    assert secrets.scan(nothing).collect() == []


def test_viterbi_is_exact():
    """Decoding between sure outside tokens gives a best path over the whole line."""
    import numpy as np

    model = secrets.trained()
    for words, _ in secrets.lines(5, 60):
        scores, n = model.emissions(words), len(words)
        best = scores[0] + np.array([0, 0, secrets._NEVER])
        for row in scores[1:]:
            best = (best[:, None] + model.moves).max(axis=0) + row
        tags = [secrets.OUT] * n
        for a, b in model.tag(words):
            tags[a : b + 1] = [secrets.BEGIN] + [secrets.INSIDE] * (b - a)
        total = sum(scores[i, t] for i, t in enumerate(tags)) + sum(model.moves[a, b] for a, b in zip(tags, tags[1:]))
        assert abs(total - best.max()) < 1e-6


def test_scan_and_redact(spark, docs, rows, nothing):
    got = secrets.scan(docs).collect()
    assert len(got) == len(rows)
    leaky = spark.createDataFrame([(1, LEAKS, 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, n_chars long")
    clean = {r.doc_id: r for r in secrets.redact(leaky, "text", "n_chars").collect()}
    assert "abcdefgh1" not in clean[1].text and "0a0a" not in clean[1].text and clean[1].n_chars == len(clean[1].text)
    assert (clean[2].text, clean[2].n_chars, clean[3].text) == (None, None, "")
    assert secrets.scan(nothing).collect() == []
    assert secrets.redact(docs).columns == docs.columns


def plain_emissions(model, words):
    """The plain sums of weights, without the cache."""
    slots = [secrets._slots(w, model.lexicon) for w in words]
    file = secrets._file_slot(sum(map(secrets._odd, words)), len(words))
    rows = [[*s[0], file] for s in slots]
    for i, row in enumerate(rows):
        for back in (1, 2, 3):
            row += slots[i - back][back] if i >= back else ()
        row += slots[i + 1][4] if i + 1 < len(words) else ()
    return np.array([model.weights[r].sum(axis=0) for r in rows])


def test_emissions_are_plain_sums_in_any_order():
    trained = secrets.trained()
    weights = np.random.default_rng(3).normal(size=trained.weights.shape)
    model = secrets.Crf(weights, trained.moves, trained.lexicon)
    words = [f(c * n) for n in (1, 2, 7, 8, 11, 12, 13, 14, 15, 16, 17) for c in ("ab", "é", "z") for f in (str.lower, str.upper, str.capitalize)]
    words += ["aª中", "ab中文", "中文ab", "A中", "AB中", "ǅa", "token", "Token", "naïve", "x1", "=", "a_b", "straße", "ÉCOLE"]
    for seed in range(6):
        random.Random(seed).shuffle(words)
        model.clear()
        for part in (words[:40], words, words[::-1]):
            assert np.allclose(model.emissions(part), plain_emissions(model, part))


# -- language ----------------------------------------------------------------------------------------------------


def test_gradients():
    import numpy as np

    rng = np.random.default_rng(1)
    net = language.train([b"abc abd"], ["a"], windows=2, rounds=1)
    net = language.Network(["a", "b"], *(rng.normal(0, 0.5, s) for s in ((2, 256, 24), (2, 8, 24), (16, 2), (2,))))
    net.inputs, net.state = net.inputs.astype(np.float64), net.state.astype(np.float64)
    steps, target = rng.integers(97, 102, (6, 3)), np.array([0, 1, 1])

    def loss():
        p = net.probabilities(steps)[0]
        return -np.log(p[:, np.arange(3), target]).mean()

    grads = language._gradients(net, steps, target)
    for p, g in zip((net.inputs, net.state, net.out, net.bias), grads):
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in p.shape) if p is not net.inputs else (int(rng.integers(2)), int(rng.integers(97, 102)), int(rng.integers(24)))
            keep, eps = p[at], 1e-2
            p[at] = keep + eps
            up = loss()
            p[at] = keep - eps
            down = loss()
            p[at] = keep
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3


def test_language(spark, sf_dir, docs, rows, nothing):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.detect_language(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    odd = language.detect_language(docs.unionByName(docs.limit(1).withColumn("text", language.F.lit("12 34 !?"))))
    assert {(r.lang_pred, r.score) for r in odd.collect() if r.doc_id == 32} == {("und", 0.0)}
    assert odd.count() == len(rows) + 1
    assert language.detect_language(nothing).collect() == []


# -- quality -----------------------------------------------------------------------------------------------------


def test_quality(spark, docs, rows, nothing):
    rng = random.Random(2)
    made, labels = [], []
    for i in range(600):
        kind = i % 3
        text = sentence(rng, 60)
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 2:
            text = text.replace(" river ", " scoundrel ", 2) + " scoundrel"
        made.append((i, text, "en", f"s{i % 7}"))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, marks).collect()}
    assert len(got) == 600
    assert sum(got[i].keep == (i % 3 == 0) for i in got if i % 2 == 0) / 300 > 0.97
    kept = quality.keep_good(df, marks)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}
    assert quality.classify(docs, marks).count() == len(rows)
    assert quality.keep_good(docs, marks.limit(0)).columns == docs.columns
    assert quality.classify(nothing, marks).collect() == []


def test_shrinkage(spark):
    """A sparse path keeps near its host, a rich one near its own rate."""
    rows = [("h", "a", 5.0, -5.0)] * 400 + [("h", "b", -5.0, -5.0)] * 400 + [("h", "c", 5.0, -5.0)] + [("g", "a", -5.0, -5.0)] * 300
    df = spark.createDataFrame(rows, "host string, path string, low_evidence double, toxic_evidence double")
    got = {(r.host, r.path): r.low_rate for r in quality.site_rates(df, "host", "path", {"low": 0.0, "toxic": 0.0}).collect()}
    assert got["h", "a"] > 0.9 and got["h", "b"] < 0.1 and 0.2 < got["h", "c"] < got["h", "a"] and got["g", "a"] < 0.1


# -- queries and pipeline ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sf_dir, name):
    table = "conversations" if name == "op7_chat" else "documents"
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    got = QUERIES[name](spark, sf_dir)
    if name == "op1_decontamination":
        assert {"doc_id", "item_id"} <= set(got.columns)
    elif name == "op7_chat":
        assert got.count() == n.select("conv_id").distinct().count() + 1
    elif name == "op13_whitening":
        assert got.count() == 32 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    else:
        assert got.count() == n.count()


# -- plain versions of the models --------------------------------------------------------------------------------


def test_network_by_loops():
    """Every byte's probabilities, from the gate equations written out one unit at a time."""
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    h, labels = 3, ["a", "b", "c"]
    net = language.Network(
        labels, *(rng.normal(0, 0.7, s).astype(np.float32) for s in ((2, 256, 3 * h), (2, h, 3 * h), (2 * h, 3), (3,)))
    )
    text = b"ab\xffz a"
    p, _ = net.probabilities(np.frombuffer(text, np.uint8).reshape(-1, 1))
    sig = lambda x: 1 / (1 + math.exp(-x))
    states = []
    for d in (0, 1):
        w, u, now, found = net.inputs[d].tolist(), net.state[d].tolist(), [0.0] * h, {}
        for t in range(len(text)) if d == 0 else reversed(range(len(text))):
            x = w[text[t]]
            z = [sig(x[k] + sum(now[j] * u[j][k] for j in range(h))) for k in range(h)]
            r = [sig(x[h + k] + sum(now[j] * u[j][h + k] for j in range(h))) for k in range(h)]
            n = [math.tanh(x[2 * h + k] + sum(r[j] * now[j] * u[j][2 * h + k] for j in range(h))) for k in range(h)]
            now = [n[k] + z[k] * (now[k] - n[k]) for k in range(h)]
            found[t] = now
        states.append(found)
    for t in range(len(text)):
        both = states[0][t] + states[1][t]
        scores = [math.exp(sum(both[j] * float(net.out[j, k]) for j in range(2 * h)) + float(net.bias[k])) for k in range(3)]
        assert all(abs(float(p[t, 0, k]) - scores[k] / sum(scores)) < 1e-4 for k in range(3))
    whole = net.probabilities(np.frombuffer(text.ljust(language.STEPS), np.uint8).reshape(-1, 1))[0]
    assert np.allclose(net.documents([text, b""]), [whole[: len(text), 0].mean(axis=0), [0, 0, 0]], atol=1e-5)


@pytest.mark.parametrize("text", ["½ ²", "①", "12 _", "", None, "٣"])
def test_no_letter_is_undetermined(spark, text):
    import numpy as np

    net = language.Network(["en"], *(np.zeros(s, np.float32) for s in ((2, 256, 3), (2, 1, 3), (2, 1), (1,))))
    assert [tuple(r) for r in language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert language.identify(spark.createDataFrame([(1, "é")], "doc_id long, text string"), net).first().lang_pred == "en"


def test_posteriors_by_loops(spark, sf_dir):
    """Rates of hosts and paths, their shrinkage and every document's posterior, recomputed from the evidence."""
    import math

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    models = quality.train(docs, labels)
    names = {k: f"{k}_evidence" for k in quality.TARGETS}
    rows = quality.with_evidence(docs, models, names).collect()
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    for k in quality.TARGETS:
        chance = [1 / (1 + math.exp(-(r[names[k]] + models[k].base))) for r in rows]
        hosts, paths = {}, {}
        for r, c in zip(rows, chance):
            for table, key in ((hosts, r.source), (paths, (r.source, r.lang))):
                n, s = table.get(key, (0, 0.0))
                table[key] = (n + 1, s + c)
        rate = clip(sum(chance) / len(rows))

        def strength(spread, groups):
            within = rate * (1 - rate)
            return min(max(within / max((spread - groups * within) / len(rows), 1e-6), 10.0), 1e5)

        weight = strength(sum(n * (s / n - rate) ** 2 for n, s in hosts.values()), len(hosts))
        host_rate = {h: clip((s + weight * rate) / (n + weight)) for h, (n, s) in hosts.items()}
        weight = strength(sum(n * (s / n - host_rate[h]) ** 2 for (h, _), (n, s) in paths.items()), len(paths))
        path_rate = {p: clip((s + weight * host_rate[p[0]]) / (n + weight)) for p, (n, s) in paths.items()}
        for r in rows:
            q = path_rate[r.source, r.lang]
            want = 1 / (1 + math.exp(-(r[names[k]] + math.log(q / (1 - q)))))
            assert abs(got[r.doc_id][f"{k}_posterior"] - want) < 1e-6


def test_quality_ranks_held_out_documents(spark):
    """Trained on one half of the labels, the posterior of the other half ranks them: area under the curve."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 4 = 0")
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(docs.select("doc_id"), "doc_id")
    held = {r.doc_id: r for r in labels.where("doc_id % 8 = 4").collect()}
    got = {r.doc_id: r for r in quality.classify(docs, labels.where("doc_id % 8 = 0")).collect()}

    def area(score, positive):
        ranked = sorted(held, key=score)
        hits, below, total = sum(map(positive, ranked)), 0, 0
        for i in ranked:
            if positive(i):
                total += below
            else:
                below += 1
        return total / max(1, hits * below)

    assert area(lambda i: got[i].low_posterior, lambda i: held[i].quality == 0) > 0.85
    assert area(lambda i: got[i].toxic_posterior, lambda i: held[i].toxic == 1) > 0.85


def test_a_block_of_items_stays_small():
    """What a task builds of a full block of benchmark text is bounded."""
    import os
    import subprocess
    import sys

    code = (
        "import random, resource, sys\nfrom spanweave.llm import decontaminate as D\nrng = random.Random(1)\n"
        "items = [(k, ' '.join(''.join(rng.choices('abcdefghijklmnopqrstuvwxyz', k=rng.randint(2, 9))) for _ in range(60))) for k in range(D.BLOCK_BYTES // 400)]\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nm = D.Matcher(items, 0.1)\n"
        "assert dict(m.search('x ' + items[7][1] + ' y')) == {7: 0}\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=here)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 400

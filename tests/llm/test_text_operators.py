"""Every text operator on awkward rows, and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablegauge.llm import exact, near, packing, piece_codec, quality_model, quality_rules, secrets, suffixes, surrogates, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, body string, digest int, rid string, shard int"
WORDS = "the of and stone river light amber cloud seven north hollow bright table engine copper".split()


def table(spark, rows):
    """Rows (doc_id, text) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1, "y", 2) for i, t in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and blank texts, repeated rows, ties, copies, a long text, odd characters."""
    base = prose(1, 120)
    near_copy = base.replace(base.split()[60], "changed", 1)
    long_text = prose(2, 12_000)
    return [(1, base), (2, None), (3, ""), (4, " \t\n"), (5, base), (5, base), (6, near_copy), (None, None), (None, base),
            (7, long_text), (8, long_text[500:1200] + " tail"), (9, "one two"), (10, "One TWO"), (11, "one  two\n"),
            (12, "é 日本 \x00 😀 ▁ x"), (13, "a" * 500), (14, "be " * 300), (15, base + " " + base), (16, "x" * 199)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def labelled(spark, ids, value):
    return spark.createDataFrame([(i, value(i), value(i)) for i in ids], "doc_id bigint, quality int, toxic int")


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_repeated_passages_match_brute_force(frame, rows):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(b[p:p + 200] for b in texts for p in range(len(b) - 199))
    want = []
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - 199):
            if times[b[p:p + 200]] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        kept = bytes(c for c, g in zip(b, cut) if not g)
        want.append((i, len(b), int(cut.sum()), int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
           for r in collected(suffixes.repeated_passages(frame))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeated_passages_split_hot_grams_alike(frame, monkeypatch):
    want = sorted(map(str, collected(suffixes.repeated_passages(frame))))
    monkeypatch.setattr(suffixes, "GROUP_SEGMENTS", 1)
    monkeypatch.setattr(suffixes, "BLOCK", 300)
    assert sorted(map(str, collected(suffixes.repeated_passages(frame)))) == want


def test_suffix_sort_orders_suffixes():
    r = random.Random(5)
    data = bytes(r.choice(b"ab") for _ in range(3000)) + b"c" * 250
    raw = np.frombuffer(data, dtype=np.uint8)
    starts = np.array(r.sample(range(3000), 700))
    group = np.sort(np.array([r.randrange(9) for _ in starts]))
    got = suffixes.suffix_sort(raw, suffixes.PrefixHashes(raw), starts, group)
    for g in set(group.tolist()):
        mine = [data[s:s + 200] for s in got[group == g]]
        assert mine == sorted(mine) and sorted(got[group == g]) == sorted(starts[group == g])


def test_toxicity_learns_disguised_words(spark):
    r = random.Random(4)
    bad = ["blargword", "snorfish", "grumbling"]
    texts = []
    for i in range(400):
        words = prose(i + 100, 40).split()
        words = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words]
        if i % 4 == 0:
            words[r.randrange(40)] = bad[i // 4 % 3]
        texts.append((i, " ".join(words)))
    disguised = [(1000, "river bl4rgw0rd stone"), (1001, "the s n o r f i s h of"), (1002, "grrrrumbling amber"),
                 (1003, "river stone light"), (1004, None), (1005, ""), (None, "the of and")]
    docs = table(spark, texts + disguised)
    labels = labelled(spark, range(400), lambda i: int(i % 4 == 0))
    got = {r["doc_id"]: r for r in collected(toxicity.toxicity(docs, labels))}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005, None)] == [1, 1, 1, 0, 0, 0, 0]
    assert got[1004]["score"] == got[1005]["score"] and not got[None]["held_out"]
    assert got[5]["held_out"] == (zlib.crc32(b"5") % 3 == 1)
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_toxicity_takes_back_one_doubled_letter(spark):
    texts = [(i, f"{prose(i + 100, 20)} {'snorfless' if i % 4 == 0 else 'harbour'}") for i in range(400)]
    disguised = ["snoorfless", "snorrfless", "snorflless", "ssnorfless", "s  n o\to r f\nl e s s", "(snoorfless)"]
    plain = ["harbour", "haarbour", "bookkeeper"]
    docs = table(spark, texts + [(1000 + i, f"river {w} stone") for i, w in enumerate(disguised + plain)])
    got = {r["doc_id"]: r["predicted"] for r in collected(toxicity.toxicity(docs, labelled(spark, range(400), lambda i: int(i % 4 == 0))))}
    assert [got[1000 + i] for i in range(9)] == [1] * 6 + [0] * 3
    model = toxicity.language_model(docs)
    assert {"snoorfless", "snorfless"} <= set(toxicity._readings("snoorfless", model))
    assert toxicity._readings("river", model) == ["river"]


def test_long_spaced_runs_stay_small():
    model = np.ones(toxicity.ALPHABET**toxicity.ORDER, dtype=np.float32)
    r = random.Random(1)
    letters = "".join(pair for _ in range(10_000) for pair in [r.choice("ac") + r.choice("gt")])
    words = toxicity.restored_words(" ".join(letters), model)
    # Few windows of 7 letters are distinct; 256 closed words have up to 256 letters.
    assert sum(map(len, words)) < 100_000
    short = "acgtacgatat"
    assert {short[i:] for i in range(len(short) - 2)} <= toxicity.restored_words(" ".join(short), model)
    stems = {f for i in range(100) for f in toxicity.features(letters[i:])[:-1]}
    assert stems <= {f for w in words for f in toxicity.features(w)}
    fitted = toxicity.ToxicityModel(model, {letters[500:507]: 0.9, f"{letters[-9:]} ": 0.8}, 0.0)
    assert fitted.score(" ".join(letters)) == pytest.approx(0.98)
    assert toxicity.restore(f"{letters}!", model).startswith(letters)


def test_models_on_empty_tables(spark, frame, empty):
    none = labelled(spark, [], int)
    for fit in (toxicity.toxicity, quality_model.quality):
        assert fit(empty, none).count() == 0
        got = collected(fit(frame, none))
        assert len(got) == frame.count() and all(0 <= r["score"] <= 1 for r in got)
        got = collected(fit(frame, labelled(spark, [1, 2, None], lambda i: None if i == 2 else 1)))
        assert len(got) == frame.count()


def test_quality_model_separates(spark):
    texts = [(i, prose(i, 80) if i % 3 else "### $$$ " * (i % 7 + 5)) for i in range(300)]
    got = collected(quality_model.quality(table(spark, texts), labelled(spark, range(300), lambda i: int(i % 3 > 0))))
    out = [r for r in got if r["held_out"]]
    assert out and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in out)


def test_trees_traverse_as_they_were_grown():
    random_ = np.random.default_rng(2)
    x = random_.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality_model.fit(x, y)

    def walk(row):
        total = forest.base
        for root in forest.roots:
            at = root
            while np.isfinite(forest.cut[at]):
                at = forest.left[at] + int(row[forest.feature[at]] > forest.cut[at])
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))
    assert np.allclose(forest.predict(x), [walk(r) for r in x])
    assert ((forest.predict(x) > 0.5) == y).mean() > 0.95


def components(rows, width=4):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            same_id = rows[a][0] == rows[b][0] and rows[a][0] is not None
            linked = x and y and None not in (rows[a][0], rows[b][0]) and 100 * len(x & y) >= 80 * len(x | y)
            if same_id or linked:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(sets[a]), None if i is None else least[find(a)]) for a, (i, _) in enumerate(rows)]


def near_rows():
    r = random.Random(9)
    out = []
    for g in range(6):
        words = prose(g + 40, 90).split()
        for k in range(12):
            mine = list(words)
            for _ in range(r.randrange(5)):
                mine[r.randrange(len(mine))] = f"w{r.randrange(10**6)}"
            out.append((g * 100 + k, " ".join(mine)))
    passage = prose(77, 60)
    out += [(1000 + k, passage + " " + prose(500 + k, 60)) for k in range(40)]
    return out


@pytest.mark.parametrize("which", ["awkward", "groups"])
def test_near_duplicates_match_brute_force(spark, rows, which):
    data = rows if which == "awkward" else near_rows()
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in collected(near.near_duplicates(table(spark, data)))]
    assert sorted(got, key=str) == sorted(components(data), key=str)


def test_connected_follows_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r["node"]: r["component"] for r in collected(near.connected(spark.createDataFrame(edges, "a bigint, b bigint")))}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_quality_rules_count_by_hand(frame, rows):
    got = sorted(collected(quality_rules.quality_rules(frame)), key=str)
    want = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if wins[tuple(w[k:k + 3])] > 1 for d in range(3)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit),
                     len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert "Python" not in quality_rules.quality_rules(frame)._jdf.queryExecution().executedPlan().toString()


def test_piece_codec_equals_the_library(spark, frame, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(3)
    own = piece_codec.PieceCodec(open(PIECES, "rb").read())
    texts = [t or "" for _, t in rows] + ["".join(r.choice(r.choice(["ab ", "the andingion", "éèñ ó\n", " ▁\n\t", "日本😀 語", "    "]))
                                                  for _ in range(r.randint(1, 60))) for _ in range(300)]
    for t in texts:
        want = library.encode(t, add_bos=True, add_eos=True)
        ids = own.encode(t)
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert own.decode(ids).decode() == library.decode(want)
    digests = sorted(((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in collected(piece_codec.round_trip(frame, PIECES))), key=str)
    assert digests == sorted(((i, len(library.encode(t or "", add_bos=True, add_eos=True)), hashlib.sha256(
        library.decode(library.encode(t or "", add_bos=True, add_eos=True)).encode()).hexdigest()) for i, t in rows), key=str)
    back = collected(piece_codec.decode(piece_codec.encode(frame, PIECES), PIECES))
    assert sorted((r["text"] for r in back)) == sorted(library.decode(library.encode(t or "")) for _, t in rows)


def test_packing_holds_every_token_once(frame, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    got = collected(packing.pack(frame, BPE, shard_pieces=7))
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 2048) + 4  # four shards
    whole = packing.pack(frame, BPE).select("sequence_id").distinct().count()
    assert whole <= -(-total // 2048) + 1


def test_crossover_keeps_every_piece():
    random_ = np.random.default_rng(1)
    sizes = random_.integers(1, 1500, 400)
    people = []
    for k in range(2):
        bins, room = [], []
        packing.best_fit(sizes, random_.permutation(400).tolist(), bins, room, 2048)
        people.append((bins, room))
    bins, room = packing.cross(sizes, *people, 2048, random_)
    assert sorted(i for b in bins for i in b) == list(range(400))
    assert [2048 - sizes[b].sum() for b in bins] == room and min(room) >= 0
    best = packing.evolve(sizes, [people[0][0]], 3, 2048)
    assert len(best[0]) <= min(len(p[0]) for p in people)


def test_exact_duplicates_match_brute_force(frame, rows):
    group = {}
    for i, t in rows:
        group.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, len(t or "")))
    want = []
    for body, members in group.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        want += [(i, keep[0], len(members), (i, n) == keep, hashlib.sha256(body.encode()).hexdigest()) for i, n in members]
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for hot_rows in (exact.HOT_ROWS, 1):
        out = exact.exact_duplicates(frame, hot_rows=hot_rows)
        assert sorted((tuple(r[c] for c in names) for r in collected(out)), key=str) == sorted(want, key=str)
    one = collected(exact.without_copies(frame))
    assert len(one) == len(group) and set(one[0]) == set(frame.columns)


SECRETS = [(1, 'password: "hunter22x" then'), (2, "token=abc12 short"), (3, "AKIA" + "Z9" * 9), (4, "f" * 24 + " " + "e" * 23),
           (5, None), (6, ""), (7, "é😀 Api_Key = 'abc.def-1' x"), (7, "Secret=longenough"), (8, 'password: "hunter22x" then'),
           (None, "passwd:123456"), (9, "apikey=AKIA" + "B" * 20 + " " + "0" * 40),
           (10, "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----")]


def found_by_hand(text):
    out = []
    for k, (kind, pattern) in enumerate((
            ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
            ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))):
        for m in re.finditer(pattern, text):
            size = len(m[1]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_secret_scans_use_the_ledger(spark, empty):
    versions = table(spark, SECRETS)
    findings, entries = secrets.scan_versions(versions, secrets.read_ledger(spark, None))
    got = sorted(((r["doc_id"], r["base_sha256"]) for r in collected(secrets.span_digest(findings))), key=str)
    assert got == sorted(((i, hashlib.sha256(found_by_hand(t or "").encode()).hexdigest()) for i, t in SECRETS), key=str)
    assert entries.count() == len({t or "" for _, t in SECRETS})
    again, more = secrets.scan_versions(versions, entries)
    assert more.count() == 0 and sorted(map(str, collected(again))) == sorted(map(str, collected(findings)))
    newer, added = secrets.scan_versions(table(spark, [*SECRETS, (11, "token = 0123456789")]), entries)
    assert added.count() == 1 and newer.count() == len(SECRETS) + 1
    masked = {(r["doc_id"], r["text"]) for r in collected(secrets.without_secrets(versions, secrets.read_ledger(spark, None)))}
    assert (1, "<secret>\" then") in masked and (2, "token=abc12 short") in masked and (10, "<secret>") in masked
    assert len(collected(secrets.without_secrets(versions, secrets.read_ledger(spark, None)))) == len(SECRETS)


@pytest.mark.parametrize("operator", [
    suffixes.repeated_passages, near.near_duplicates, quality_rules.quality_rules, exact.exact_duplicates,
    lambda d: surrogates.replace_entities(d, b"k"), exact.without_copies, near.without_near_copies, lambda d: piece_codec.round_trip(d, PIECES), lambda d: packing.pack(d, BPE),
    lambda d: secrets.scan_versions(d, secrets.read_ledger(d.sparkSession, None))[0],
    lambda d: secrets.without_secrets(d, secrets.read_ledger(d.sparkSession, None))])
def test_empty_tables(empty, operator):
    assert operator(empty).count() == 0


def test_surrogates_keep_form_and_identity(spark, empty):
    texts = [(1, "mail jo.81@mail7.example.com or +1 (098) 555-0174 from 191.26.250.130"), (2, "again JO.81@mail7.example.com, ab@x.de"),
             (3, None), (4, ""), (None, "card 4266 2614 4439 2889 x 4111111111111111"), (5, "Frau Schmidt and Mr. Smith met Frau Schmidt"),
             (5, "Frau Schmidt and Mr. Smith met Frau Schmidt"), (6, "nothing here 1234")]
    got = collected(surrogates.replace_entities(table(spark, texts), b"k"))
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    first = by[1]["text"].split()
    assert "jo.81" not in by[1]["text"] and first[1].endswith(".com") and first[3] == "+1" and "191.26" not in by[1]["text"]
    assert by[2]["text"].split()[1].rstrip(",") == first[1] and by[2]["n_entities"] == 2
    names = re.findall(r"(?:Frau|Mr\.) (\w+)", by[5]["text"])
    assert names[0] == names[2] != names[1] and names[0].endswith("na") and "Schmidt" not in by[5]["text"]
    assert by[6]["text"] == "nothing here 1234" and by[3]["text"] == by[4]["text"] == ""
    assert "4111111111111111" not in by[None]["text"]
    assert surrogates.replace_entities(empty, b"k").count() == 0


@pytest.mark.parametrize("text, gone", [
    ("Mr John Michael Smith said", "John Michael Smith"), ("Herr Jean-Pierre Dupont", "Jean-Pierre Dupont"),
    ("Señor José García López", "José García López"), ("Mr J. Smith", "J Smith"), ("Mr O'Brien", "O'Brien"),
    ("Frau Dr. von der Müller-Lüdenscheidt", "Müller-Lüdenscheidt"), ("господин Иван Петрович Сидоров", "Иван Петрович Сидоров"),
    ("on 01 23 45 67 89.", "01 23 45 67 89"), ("on +33 1 23 45 67 89.", "+33 1 23 45 67 89"), ("on 030 1234567.", "030 1234567"),
    ("on (030) 1234567.", "(030) 1234567"), ("on 555.123.4567.", "555.123.4567"), ("on 8 (495) 123-45-67.", "8 (495) 123-45-67")])
def test_entities_are_found_whole(text, gone):
    found = surrogates.find_parts(text)
    assert " ".join(text[b:e] for b, e, *_ in found) == gone and len({p[4:] for p in found}) == 1


def test_no_entities_in_plain_numbers_and_words():
    for text in ("1 023 456 789", "2024-01-02 10:11", "mr smith went", "Smith said", "01 23 45 67 89 10 11"):
        assert surrogates.find_parts(text) == []


def test_persons_keep_their_surrogates_under_every_name(spark):
    texts = [(1, "Smith came. Mr John Smith and Mr J. Smith met Mr O'Brien; SMITH's John, Smith-like, Smithson"),
             (2, "Mr Smith met Mrs Smith, and Smith left"), (3, "Smith alone")]
    got = {r["doc_id"]: r for r in collected(surrogates.replace_entities(table(spark, texts), b"k"))}
    m = re.fullmatch(r"(\w+) came\. Mr (\w+) (\w+) and Mr (\w)\. (\w+) met Mr (\w'\w+); (\w+)'s (\w+), (\w+)-like, Smithson", got[1]["text"])
    smith, john = m[3], m[2]
    assert m[1] == m[5] == m[9] == smith != "Smith" and m[7] == smith.upper() and m[8] == john not in ("John", smith)
    assert m[4].isupper() and m[4] != "J" and m[6] != "O'Brien"
    assert got[1]["n_entities"] == 7 and "name:15:25" in got[1]["spans"].split(",")
    m = re.fullmatch(r"Mr (\w+) met Mrs (\w+), and (\w+) left", got[2]["text"])
    assert m[1] == smith != m[2] == m[3] and m[2].endswith("na")
    assert got[3]["text"] == "Smith alone" and len({surrogates.initial(b"k", c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}) == 26

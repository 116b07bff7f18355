"""Operators against brute force, round trips and their SQL."""

import hashlib
import random
import re
import string
import time
from html.parser import HTMLParser
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import TABLES, assert_same
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumic.llm import chat_format, decontamination, html_layout, neardup, pii, quality_rules, queries, secret_scan, token_counts
from vellumic.llm._shingles import shingle_set


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# Token counts
def encoder():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


def test_token_counts(spark, sf_dir, documents):
    sp = encoder()
    want = {i: (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for i, t in documents}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, sf_dir).collect()}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "▁", "<s>", "é", "ﬁ", "the quick", "\r", " ", "日本", "e\u0301", "\t"]), max_size=60).map("".join), st.integers(1, 9))
def test_parts_count_as_the_whole(text, chars):
    sp, split = token_counts.model(queries.tokenizer_path())
    assert split
    assert sum(len(sp.encode(p)) for p in token_counts.safe_parts(text, chars)) == len(sp.encode(text))


# Near duplicates
def brute_components(docs, percent=85):
    sets = {i: set(shingle_set(t).tolist()) for i, t in docs}
    root = {i: i for i, _ in docs}
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i, _ in docs}


def near_copies(seed=5):
    """Chains and stars of near copies, some of them far larger than a small node."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs, number = [], 0
    for size, length, most in ((230, 120, 6), (30, 60, 3), (12, 8, 1), (40, 200, 25)):
        base = [word() for _ in range(length)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, most)):
                copy[rng.randrange(length)] = word()
            docs.append((number, " ".join(copy)))
            number += 1
    chain = [word() for _ in range(100)]
    for _ in range(60):
        chain[rng.randrange(100)] = word()
        docs.append((number, " ".join(chain).upper()))
        number += 1
    passage = " ".join(word() for _ in range(30))
    docs += [(number + k, passage + " " + " ".join(word() for _ in range(60))) for k in range(250)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    docs = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect()}
    assert got == brute_components(docs, percent)


def test_tokens_of_a_step():
    assert [neardup.tokens_of_step(p) for p in (85, 80, 50, 100)] == [4, 3, 1, 65]


def test_deep_nodes_and_blocks(spark, monkeypatch):
    """With tiny nodes every path goes down all levels and into blocks, and finds the same."""
    monkeypatch.setattr(neardup, "SMALL", 8)
    docs = near_copies(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_components(docs)
    assert sum(got[i] != want[i] for i in want) <= 3


def test_rows_of_nodes(spark, monkeypatch):
    """A group of near copies that shares a passage with other texts goes through few nodes, and finds the same."""
    monkeypatch.setattr(neardup, "SMALL", 24)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, base = [word() for _ in range(30)], [word() for _ in range(60)]
    docs = []
    for k in range(300):
        copy = list(base)
        copy[rng.randrange(60)] = word()
        docs += [(2 * k, " ".join(passage + copy)), (2 * k + 1, " ".join(passage + [word() for _ in range(60)]))]
    join, made = neardup.join_counted, []

    def counted(rows, table, key, *more):
        out = join(rows, table, key, *more)
        made.extend([out.count()] if key == "node" else [])
        return out

    monkeypatch.setattr(neardup, "join_counted", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i if i % 2 else 0 for i, _ in docs}
    assert sum(made) <= 15_000


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=2, max_size=12))
def test_exact_links(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert set(zip(*(x.tolist() for x in neardup.linked(arrays)))) == want


# Decontamination
def brute_overlap(text, item):
    """Whether some alignment has a run of 20 words (or the item) of which 80 % agree, or one of 13 words that all do."""
    doc, words = text.lower().split(), item.lower().split()
    run, exact = min(20, len(words)), min(13, len(words))
    for offset in range(-len(words) + 1, len(doc)):
        same = [0 <= offset + k < len(doc) and doc[offset + k] == w for k, w in enumerate(words)]
        if any(100 * sum(same[s : s + run]) >= 80 * run for s in range(len(words) - run + 1)):
            return True
        if any(all(same[s : s + exact]) for s in range(len(words) - exact + 1)):
            return True
    return False


def test_parts_of_items():
    item = " ".join(f"i{k}" for k in range(40))
    seeds = decontamination.Seeds([(7, item)])
    part = lambda n: "x y z " + " ".join(item.split()[9 : 9 + n]) + " a b c"
    assert [len(d) for d in decontamination.overlaps([part(12), part(13), part(30)], seeds, seeds.unpacked())] == [0, 1, 1]


def test_substituted_passages_are_found():
    rng = random.Random(1)
    vocabulary = [f"t{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((15, 25, 40, 60))))) for k in range(40)]
    seeds = decontamination.Seeds(items)
    tables = seeds.unpacked()
    missed = wanted = wrong = 0
    for _ in range(150):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, len(words) // 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        cut = rng.randrange(len(words) // 2)
        text = " ".join(rng.choices(vocabulary, k=60) + words[cut:] + rng.choices(vocabulary, k=60))
        got = {seeds.ids[k] for k in decontamination.overlaps(["", text, text], seeds, tables)[2]}
        want = {k for k, t in items if brute_overlap(text, t)}
        wrong += len(got - want)
        missed += len(want - got)
        wanted += len(want)
    assert wrong == 0 and wanted > 60 and missed <= 0.02 * wanted


def test_short_items_with_substitutions(spark, sf_dir, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"t{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=3 + k % 10))) for k in range(80)]
    docs = []
    for k in range(400):
        words = rng.choice(items)[1].split()
        for place in rng.sample(range(len(words)), rng.randint(0, 3)):
            words[place] = rng.choice(vocabulary)
        before, after = (rng.choices(vocabulary, k=rng.choice((0, 20))) for _ in range(2))
        docs.append((k, " ".join(before + words[rng.randint(0, 1) :] + after)))
    for name in TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        (tmp_path / f"{name}.parquet").unlink()
        pq.write_table(pa.table({key: [k for k, _ in rows], "text": [t for _, t in rows]}), tmp_path / f"{name}.parquet")
    got = queries.op4_decontamination(spark, str(tmp_path))
    assert got.where("n_agree < item_words").count() > 50
    assert_same(got, queries.ORACLES["op4_decontamination"], str(tmp_path))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 200), min_size=1), st.sets(st.integers(0, 90), min_size=1))
def test_differences(p, q):
    got = decontamination.differences(np.array(sorted(p)), np.array(sorted(q)))
    assert got.tolist() == sorted({x - y for x in p for y in q})


def test_repeated_words_stay_cheap():
    """One word over and over, in the item and in the documents, does not multiply."""
    items = [(0, "the " * 1200), (1, "the " * 9), (2, "a b c d e f " * 50)]
    seeds = decontamination.Seeds(items)
    start = time.perf_counter()
    found = decontamination.overlaps(["the " * 8000, "the " * 8, "x " + "a b c d e f " * 300, ""], seeds, seeds.unpacked())
    assert time.perf_counter() - start < 20
    assert [sorted(f.items()) for f in found] == [[(0, (1200, 0)), (1, (9, 0))], [(1, (8, -1))], [(2, (300, 1))], []]


@pytest.mark.parametrize("least, want", [(1, {1, 2, 3}), (2, {2, 3}), (5, {3})])
def test_items_of_few_words(least, want):
    seeds = decontamination.Seeds([(1, "One"), (2, "two three"), (3, "four five six seven eight")], least)
    found = decontamination.overlaps(["x one TWO three y four five six seven nine"], seeds, seeds.unpacked())
    assert {seeds.ids[k] for k in found[0]} == want


# Secrets
def brute_secrets(text):
    found = []
    for kind, pattern, group, least in (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, m in enumerate(re.finditer(pattern, text)) if len(m[group]) >= least for k in [("assign", "access", "hex").index(kind)]]
    return [s for _, _, s in sorted(found)]


SECRETS = st.lists(st.sampled_from(["password", "PassWord", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef" * 4, "0123abcd", "é", "ſecret", "secret", "x", "\n", "."]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(SECRETS)
def test_base_secrets(text):
    base, every = secret_scan.scan(text)
    assert [f"{k}:{a}:{b}" for k, a, b in base] == brute_secrets(text)
    assert set(base) <= set(every) and every == sorted(every, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]), s[2]))


def test_base_secrets_of_documents(spark, sf_dir, documents):
    got = {r.doc_id: r.base_sha256 for r in queries.op5_secret_scan(spark, sf_dir).collect()}
    assert got == {i: hashlib.sha256(",".join(brute_secrets(t)).encode()).hexdigest() for i, t in documents}


#: Words of names that the tests make up; the dictionary was not made from these names.
NAME_WORDS = "user account service manager render button click payment invoice refund shipping address handler factory controller repository session cache config loader parser writer reader stream buffer queue worker thread lock event listener callback filter sort merge split update delete insert customer order product catalog inventory warehouse tracker schedule calendar reminder message inbox template layout widget canvas color theme font image upload download archive backup restore snapshot cluster node replica shard index search query result page cursor offset limit".split()
SETTINGS = ("bearer {} end", "client_id = '{}'\nrun(client)", "my auth {}", "{} is my secret", "export AUTH_KEY={}", "auth {}=")


def novel(value, rng):
    """Whether the scan reports the whole of a value in some sensitive setting."""
    setting = rng.choice(SETTINGS)
    start = setting.index("{}")
    return any(k in ("novel", "hex") and a <= start and b >= start + len(value) for k, a, b in secret_scan.scan(setting.format(value))[1])


def names(style, rng):
    words = rng.sample(NAME_WORDS, rng.choice((3, 4, 5)))
    number = rng.choice(("", "2", "42"))
    if style == "camel":
        return words[0] + "".join(w.title() for w in words[1:]) + number
    joined = ("-" if style == "kebab" else "_").join(words) + number
    return joined.upper() if style == "upper" else joined


@pytest.mark.parametrize("style", ["camel", "snake", "upper", "kebab"])
def test_few_names_are_novel(style):
    rng = random.Random(style)
    assert sum(novel(names(style, rng), rng) for _ in range(500)) <= 25


@pytest.mark.parametrize("digits", [string.ascii_letters + string.digits + "+/", string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase + "234567", "0123456789abcdef", "0123456789ABCDEF"])
@pytest.mark.parametrize("length", [16, 20, 32, 40, 64])
def test_random_strings_are_novel(digits, length):
    rng = random.Random(length)
    assert sum(novel("".join(rng.choices(digits, k=length)), rng) for _ in range(200)) >= 190


@pytest.mark.parametrize("text, want", [("token_{} x", True), ("{}_token", True), ("auth" + " " * 64 + "{}", True), ("auth" + " " * 65 + "{}", False), ("{}" + " " * 64 + "auth", True), ("{}" + " " * 65 + "auth", False), ("some words {} end", False), ("secretly {}", True)])
def test_reach_of_sensitive_words(text, want):
    value = "aZ3kQ9xLm2Pw7RtY5uVbN8cD1eFgH4jK6sTzX0y"
    start = text.index("{}")
    assert (("novel", start, start + len(value)) in secret_scan.scan(text.format(value))[1]) == want


def test_repeated_and_surrounding_code_is_not_novel():
    rng = random.Random(4)
    value = "".join(rng.choices(string.ascii_letters + string.digits, k=24))
    assert not secret_scan.scan(f"auth {'xy1' * 20} x")[1]
    assert len(secret_scan.scan(f"auth {value} end")[1]) == 1
    assert len(secret_scan.scan(f"auth {value} and {value} again")[1]) == 2
    assert not secret_scan.scan(f"auth {value} and x{value[:12]} {value[12:]}x again")[1]


def brute_novel(text, novelty=secret_scan.Novelty()):
    """Runs of base64 digits, "=" only at their end, near a sensitive word, less such words, and novel."""
    base = secret_scan.base_spans(text)
    word = "(?ai:" + "|".join(w.decode() for w in secret_scan.SENSITIVE) + ")"
    near = [m.span() for m in re.finditer(word, text)]
    found = []
    for m in re.finditer("[A-Za-z0-9+/_-]+(=+(?![A-Za-z0-9+/_=-]))?", text):
        if len(m[0].rstrip("=")) < 16 or not any(m.start() - b <= secret_scan.REACH and a - m.end() <= secret_scan.REACH for a, b in near):
            continue
        inner = re.split(f"({word})", m[0])
        at = m.start()
        for k, part in enumerate(inner):
            trimmed = part.lstrip("_-")
            start = at + len(part) - len(trimmed)
            trimmed = trimmed.rstrip("_-") if k + 1 < len(inner) else trimmed
            at, end = at + len(part), start + len(trimmed)
            if k % 2 or len(trimmed) < 16 or not re.search("[A-Za-z]", trimmed) or any(a < end and start < b for _, a, b in base):
                continue
            hexes = re.fullmatch("[0-9a-fA-F-]+", trimmed)
            if novelty(trimmed, (text[max(0, start - 256) : start] + "\n" + text[end : end + 256]).replace(trimmed, "\n")) >= (secret_scan.HEX_NOVELTY if hexes else secret_scan.NOVELTY):
                found.append(("novel", start, end))
    return found


VALUE = "9fA8s7Kq2LmZ0xYwT4"
NOVEL = st.lists(st.sampled_from(["AWS_SECRET_ACCESS_KEY", "auth", "signature", "client_id", "private_key", "x", "=", "==", ":", " ", "&", "?", "\n", "AKIA", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY9", VALUE, "Zx81Qw==", "q8", "_", "-", " " * 60, "tokenizedSessionHandler", VALUE + "Jx7" + VALUE[::-1]]), max_size=25).map("".join)


@pytest.mark.parametrize("length", [512, 513, 800, 1600, 100_000])
def test_long_secrets_are_taken_whole(length):
    value = "".join(random.Random(length).choices(string.ascii_letters + string.digits + "+/", k=length - 2)) + "=="
    text = f"private_key: {value}\n" + "." * 300 + f"token end {VALUE}"
    assert secret_scan.scan(text)[1] == [("novel", 13, 13 + length), ("novel", len(text) - len(VALUE), len(text))]


@settings(max_examples=400, deadline=None)
@given(NOVEL)
def test_novel_secrets(text):
    assert [s for s in secret_scan.scan(text)[1] if s[0] == "novel"] == brute_novel(text)


@pytest.mark.parametrize("before", ["AWS_SECRET_ACCESS_KEY=", "https://x.org/?auth=", "access_key=", "signature=", "client_id=", "credential=", "private_key="])
def test_values_behind_an_equals_sign(before):
    value = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY9"
    assert secret_scan.scan(f"{before}{value} end")[1] == [("novel", len(before), len(before) + len(value))]


# Personal data
def brute_pii(text):
    spans = {"email": [], "ip": [], "card": [], "phone": []}
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m)
        if 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            spans["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m)) <= 15:
            spans["phone"].append(m.span())
    return [f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v]


PII = st.lists(st.sampled_from(["a", "b.c", "@", ".", "com", "-", " ", "+", "1", "25", "256", "0", "(", ")", "4111 1111 1111 1111", "+1 (743) 555-3824", "10.0.0.1", "é", "\n", "x@y.z"]), max_size=40).map("".join)


@settings(max_examples=500, deadline=None)
@given(PII)
def test_base_pii(text):
    base, every = pii.scan(text)
    assert [f"{k}:{a}:{b}" for k, a, b in base] == brute_pii(text)
    assert set(base) <= set(every)


def test_base_pii_of_documents(spark, sf_dir, documents):
    got = {r.doc_id: r.base_sha256 for r in queries.op9_pii(spark, sf_dir).collect()}
    assert got == {i: hashlib.sha256(",".join(brute_pii(t)).encode()).hexdigest() for i, t in documents}


@pytest.mark.parametrize("text, kinds", [("iban GB82 WEST 1234 5698 7654 32 x", ["iban"]), ("GB82 WEST 1234 5698 7654 33", []), ("ssn 123-45-6789", ["ssn"]), ("number 123-45-6789", []), ("visa 378282246310005", ["account"]), ("invoice order visa 378282246310005", [])])
def test_scored_pii(text, kinds):
    assert [s[0] for s in pii.scan(text)[1]] == kinds


@pytest.mark.parametrize("text, kinds", [
    ("the syntax of 123-45-6789", []), ("tax 123-45-6789", ["ssn"]), ("taxes: 123-45-6789", []), ("near the border 123-45-6789 social", ["ssn"]), ("order 123-45-6789 social", []),
    ("synt" + "tax" + " " * 45 + "123-45-6789", []), ("tax" + " " * 45 + "123-45-6789", ["ssn"]), ("xtax" + " " * 45 + "123-45-6789", []), ("123-45-6789" + " " * 45 + "tax", ["ssn"]), ("123-45-6789" + " " * 45 + "taxi", []),
    ("DNI 12345678Z", ["dni"]), ("12345678Z", []), ("DNI 12345678A", []), ("NIE X1234567L", ["dni"]), ("X-1234567-L nif", ["dni"]),
    ("2 69 05 49 588 157 80", ["nir"]), ("2 69 05 49 588 157 81", []), ("Steuer 86 095 742 719", ["steuer"]), ("86 095 742 719", []), ("Steuer 86 095 742 718", []),
    ("routing 021000021", ["routing"]), ("021000021", []), ("routing 021000022", []), ("card 269054958815780", ["nir"]),
])
def test_context_words_stand_whole(text, kinds):
    assert [s[0] for s in pii.scan(text)[1]] == kinds


def brute_scored(text):
    """Added spans, by trying all proposed spans against the rules one by one."""
    base = pii.base_spans(text)
    rated = []
    for kind, start, end in pii.proposed_spans(text):
        words = [m for m in re.finditer(r"[^\W\d_]+", text) if (start - 48 <= m.start() and m.end() <= start) or (end <= m.start() and m.end() <= end + 48)]
        near = {w[0].lower() for w in words} | {w[0].lower().removesuffix("s") for w in words}
        told = {"iban": {"iban", "bank"}, "ssn": {"tax", "ssn"}, "account": {"visa", "card"}, "dni": {"dni"}, "nir": {"nir"}, "steuer": {"steuer"}, "routing": {"bank", "aba"}}[kind]
        total = pii.SCORES[kind] + 0.3 * bool(near & told) - 0.3 * bool(near & {"order", "invoice"})
        if total > 0.5999 and not any(a < end and start < b for _, a, b in base):
            rated.append((-round(total, 6), start, -end, pii.KINDS.index(kind), (kind, start, end)))
    out = []
    for *_, span in sorted(rated):
        if not any(a < span[2] and span[1] < b for _, a, b in out):
            out.append(span)
    return sorted(out)


SCORED = st.lists(st.sampled_from([" ", " ", ", ", "tax", "ssn", "syn", "visa", "card", "DNI", "nir", "Steuer", "bank", "aba", "order", "invoices", "x" * 30, "123-45-6789", "378282246310005", "12345678Z", "2 69 05 49 588 157 80", "269054958815780", "86 095 742 719", "021000021", "BE68 5390 0754 7034", "-", "1"]), max_size=25).map("".join)


@settings(max_examples=600, deadline=None)
@given(SCORED)
def test_added_pii(text):
    base, every = pii.scan(text)
    assert sorted(set(every) - set(base)) == brute_scored(text)


@pytest.mark.parametrize("iban", ["BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"])
@pytest.mark.parametrize("after", ["", " BIC GKCC", " SWIFT CODE", " BIC", " 12", " EUR 1250", " BE68 5390 0754 7034", ", x"])
@pytest.mark.parametrize("before", ["", "iban ", "RE12 3456 7890 "])
def test_ibans_before_other_words(before, iban, after):
    spans = [s[1:] for s in pii.scan(before + iban + after)[1] if s[0] == "iban"]
    assert spans[0] == (len(before), len(before) + len(iban)) and len(spans) == 1 + ("BE68" in after)


def test_long_runs_stay_linear():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+1" * 200_000, "f" * 31 + ("g" + "f" * 31) * 10_000, "password" * 50_000, "@" * 400_000):
        pii.scan(text)
        secret_scan.scan(text)


# Quality rules
def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen = {w for w in windows if windows.count(w) > 1}
    covered = {k + j for k, w in enumerate(windows) if w in seen for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a ", "b ", "c\n", "\n", "#x ", "\v", "é ", "  ", "a b c a b c ", "dd|"]), max_size=60).map("".join))
def test_measures(text):
    assert quality_rules.measure(text)[:6] == brute_quality(text)


def test_bad_hosts_lose_only_documents_that_break_a_rule(spark):
    clean, soft = " ".join(f"word{i}" for i in range(30)), " ".join(f"word{i}###" for i in range(30))
    rows = [(k, clean if k % 10 == 0 else soft, "bad") for k in range(100)] + [(100 + k, soft if k % 10 == 0 else clean, "good") for k in range(100)] + [(300 + k, clean, f"h{k}") for k in range(50)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_table(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {k: not (k < 100 and t == soft) for k, t, _ in rows}


# HTML
class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.out += data.split()


def test_all_visible_words(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op7_html_text(spark, sf_dir).collect():
        parser = Words()
        parser.feed(pages[r.page_id])
        parser.close()
        plain = lambda words: "".join(words).replace(" ", "")
        assert plain(w for w in r.text.split() if w != "-") == plain(w for w in parser.out if w != "-")


LAYOUT = [
    ("<p>a<p>b", "a\n\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>", "- x\n- y\n  1. 1\n  2. 2"),
    ("<table><tr><th>h<th>long head<tr><td>cell<td>2</table>", "h    | long head\ncell | 2"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a in | b"),
    ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>bbbb<td>d</table>", "wide     | c\na | bbbb | d"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td>日本<td>x<tr><td>abcde<td>e\u0301</table>", "日本  | x\nabcde | e\u0301"),
    ("<table><tr><td colspan='²'>a<td>b</table>", "a | b"),
    (f"<table><tr><td colspan={'9' * 5000} rowspan=' +{'0' * 5000}1'>a<td>b<tr><td>c</table>", "a | b\nc"),
    (f"a&#{'9' * 5000};b&#{'0' * 5000}65;c&#x{'f' * 5000};d", "a\ufffdbAc\ufffdd"),
    ("<div hidden>n</div><p style='display : none'>n</p><template>n</template>y", "y"),
    ("<div>a</div>b<span> c </span>d", "a\nb c d"),
    ("<pre> a\n  b</pre>", " a\n  b"),
    ("<script>if (a < b) '</p>'</script>ok &amp; &lt;fine&gt;", "ok & <fine>"),
    ("<b>no close <i>mis</b>nested</i>", "no close misnested"),
    ("1 < 2 and <a title='x>y'>link</a>", "1 < 2 and link"),
    ("<!-- c -->x<!-- open", "x"),
    ("<dl><dt>t<dd>d</dl>", "t\nd"),
    ("<select><option>one<option>two</select>", "one\ntwo"),
]


@pytest.mark.parametrize("html, text", LAYOUT)
def test_layout(html, text):
    assert html_layout.render(html) == text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "<div>", "</div>", "<b>", "</b>", "w1 ", "w2 ", "<", ">", "&amp;", '"', "<a href='", "<br>", "<pre>", "\n", "<!--", "-->", "<script>", "</script>"]), max_size=40).map("".join))
def test_any_markup_renders(html):
    html_layout.render(html)


@pytest.mark.parametrize("depth", [10, 149, 300, 5000])
@pytest.mark.parametrize("tag", ["div", "font", "b"])
def test_rules_hold_at_every_depth(depth, tag):
    inner = '<div hidden>no<i>no</i></p>no</div><div style="display:none"><u>no</u>no</div><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>345</table>'
    shallow = html_layout.render(f"<{tag}>{inner}")
    assert "no" not in shallow and "- b" in shallow and "345" in shallow
    assert html_layout.render(f"<{tag}>" * depth + inner + f"</{tag}>" * depth) == shallow
    assert html_layout.render("<section hidden>" + f"<{tag}>" * depth + "x" + f"</{tag}>" * depth + "no</section>yes") == "yes"


MARKS = st.lists(st.sampled_from(["<td ", "<tr ", "<table ", ">", "colspan=", "rowspan=", "²", "9" * 5000, "0", "1", "2", "-1", "+3", "'", '"', " ", "&#", "x", ";", "&amp;", "日", "a", "</td>", "</table>", "<col>", "<tbody>", "\0", "\ud7ff", "٣"]), max_size=40).map("".join)


@settings(max_examples=500, deadline=None)
@given(MARKS)
def test_any_attributes_render(html):
    html_layout.render(html)


def test_wide_tables_stay_small():
    row = "<tr><td>b" * 3000
    assert len(html_layout.render("<table><tr>" + "<td colspan=1000 rowspan=65534>a" * 3000 + row)) < 3000 * 400
    assert len(html_layout.render("<table>" + "<tr>" + "<td>" + "x" * 100_000 + "<td>y" + "<tr><td>a<td>b" * 3000)) < 600_000


def test_deep_and_long_markup():
    assert html_layout.render("<div>" * 20_000 + "x" + "</div>" * 10) == "x"
    assert html_layout.render("<b>" * 3000 + "y" + "<p>" * 3000 + "z").split() == ["y", "z"]
    html_layout.render("<a b='" * 20_000)
    html_layout.render("<script>" * 20_000)


# Chat formatting
TEXTS = st.text(st.sampled_from("\\<>/turn #\né\"x"), max_size=25)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<turn>", "a\\", ""]), TEXTS), max_size=4), max_size=4))
def test_round_trip(conversations):
    flat = [t for c in conversations for t in c]
    roles, texts = pa.array([r for r, _ in flat], pa.string()), pa.array([t for _, t in flat], pa.string())
    formatted, start, end = chat_format.assemble(roles, texts, np.array([len(c) for c in conversations], np.int64))
    assert [chat_format.parse(f) for f in formatted.to_pylist()] == conversations
    rows = [f.encode() for c, f in zip(conversations, formatted.to_pylist()) for _ in c]
    assert [chat_format.unescaped(r[a:b].decode()) for r, a, b in zip(rows, start, end)] == [t for _, t in flat]

"""Language mixtures and secret candidates against plain versions that go text by text and character by character."""

import math
import random
import re
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from vellum.llm import language, secrets


def plain_grams(text):
    text = (text or "").lower()
    if not regex.search(r"\pL", text):
        return []
    raw = (" " + regex.sub(r"[^\pL\pM]+", " ", text).strip() + " ").encode()
    return [((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(raw) - 2)]


def plain_mixture(models, grams, start, rounds):
    share = list(start)
    for _ in range(rounds):
        new = [0.0] * len(share)
        for g in grams:
            p = [s * m.get(g, m[None]) for s, m in zip(share, models, strict=True)]
            total = sum(p)
            for k, x in enumerate(p):
                new[k] += x / total / len(grams)
        moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
        share = new
        if moved < 1e-3:
            break
    return share, sum(math.log(sum(s * m.get(g, m[None]) for s, m in zip(share, models, strict=True))) for g in grams)


def plain_identify(rows, penalty=3.0, rounds=30, least=0.02):
    out, counts = {}, {}
    for i, text, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 and lang is not None and text is not None:
            own = counts.setdefault(lang, {})
            for g in plain_grams(text):
                own[g] = own.get(g, 0) + 1
    names = sorted(counts)
    models = []
    for k in names:
        total = sum(counts[k].values()) + 0.05 * 65536
        models.append({None: 0.05 / total} | {g: (n + 0.05) / total for g, n in counts[k].items()})
    for i, text, _ in rows:
        grams = plain_grams(text)
        if not grams or not names:
            out[i] = ("und", 0.0)
            continue
        alone = [sum(math.log(m.get(g, m[None])) for g in grams) for m in models]
        chosen = [alone.index(max(alone))]
        best, own = alone[chosen[0]], [1.0]
        whole, _ = plain_mixture(models, grams, [1 / len(models)] * len(models), rounds)
        for k in sorted(range(len(models)), key=lambda k: -whole[k]):
            if whole[k] < least:
                break
            if k in chosen:
                continue
            start = [*[x * 0.8 for x in own], 0.2]
            found, value = plain_mixture([models[c] for c in [*chosen, k]], grams, [x / sum(start) for x in start], rounds)
            if value - best > penalty * math.log(len(grams) + 1):
                chosen, own, best = [*chosen, k], found, value
        top = max(range(len(chosen)), key=lambda c: own[c])
        out[i] = (names[chosen[top]], own[top], {names[c]: s for c, s in zip(chosen, own, strict=True)})
    return out


def test_language_mixtures(spark):
    rng = random.Random(12)
    parts = {"aa": "ka mo ti re lu san", "bb": "zy xo qu vv wj ekt", "cc": "für schön über groß daß mü"}
    say = lambda k, n: " ".join("".join(rng.choice(parts[k].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(k, rng.randrange(4, 60)), k) for i, k in enumerate(random.Random(1).choices(list(parts), k=60))]
    rows += [(100, say("aa", 40) + ". " + say("bb", 40), None), (101, say("cc", 20) + " 1 2 3 " + say("aa", 70), None), (102, "12 !", "aa"), (103, None, "bb"), (104, "", None), (105, say("bb", 1), None)]
    rows += [(106, "Ka", None), (107, say("aa", 30) + say("bb", 30) + say("cc", 30), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = plain_identify(rows)
    got = {r.doc_id: r for r in language.identify(frame).collect()}
    for i, w in want.items():
        assert got[i].lang_pred == w[0] and got[i].score == pytest.approx(w[1], abs=1e-6), i
        if len(w) == 3:
            assert {m["lang"]: m["share"] for m in got[i].mixture} == pytest.approx(w[2], abs=1e-6), i
    assert len(want[100][2]) == 2 and len(want[107][2]) == 3


def plain_candidates(rows):
    out = []
    for i, text, source in rows:
        words = re.split(r"[\x20\x09-\x0D]+", text or "")
        at = lambda k: words[k] if 0 <= k < len(words) else ""  # noqa: E731, B023
        for k, w in enumerate(words):
            if len(w) < 16:
                continue
            for found in dict.fromkeys(re.findall(r"[A-Za-z0-9+/_\-]{16,}={0,2}", w)):
                if re.search("[0-9]", found) and re.search("[A-Za-z]", found):
                    before = " ".join([at(k - 2), at(k - 1)])
                    out.append((i, k, found, w[: w.index(found)], before, at(k + 1), source or ""))
    return out


def plain_features(found, prefix, before, after, path, logs):
    n = len(found)
    code = [ord(c) - 97 if "a" <= c <= "z" else 26 if "0" <= c <= "9" else 27 for c in found.lower()]
    kind = lambda c: "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "d" if "0" <= c <= "9" else "o"
    changes = sum(kind(a) != kind(b) for a, b in zip(found, found[1:], strict=False))
    near = f"{before} {prefix}".lower()
    has = lambda p, x: float(bool(re.search(p, x)))
    return {
        "f_length": float(n), "f_digits": sum(map(str.isdecimal, found)) / n, "f_upper": len(re.findall("[A-Z]", found)) / n, "f_lower": len(re.findall("[a-z]", found)) / n,
        "f_other": len(re.findall("[^A-Za-z0-9]", found)) / n, "f_distinct": len(set(found)) / n, "f_changes": changes / n,
        "f_transition": sum(logs[a * 28 + b] for a, b in zip(code, code[1:], strict=False)) / (n - 1), "f_hex": has("^[0-9a-f]+$", found), "f_assigned": has("[=:][\"']?$|= [\"']?$", near),
        "f_slash": float("/" in prefix or "/" in found), "f_path_test": has("test|example|fixture|sample", path.lower()),
        "f_key_before": max(has(secrets.KEY_WORDS, near), has("^(akia|ghp_|xox|sk_live)", found.lower())), "f_id_before": has(secrets.ID_WORDS, near), "f_key_after": has(secrets.KEY_WORDS, after.lower()),
    }


def test_secret_candidates_and_features(spark):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("abcdefABCDEF0123456789xyz") for _ in range(n))
    texts = [f"password={key(20)} and token: {key(33)}", f"see https://host/{key(24)}/x{key(16)}== commit\t{key(40)}\npass", "no candidates here", None, "", key(15), "a" * 30, "1" * 30, f"{key(18)}", f'key = "{key(22)}" auth', f"x,{key(17)},{key(17)}!"]
    texts += [f"{rng.choice(['sha1', 'the', 'api_key:', 'uuid'])} {rng.choice(['', 'AKIA', 'a/b/', 'test-'])}{key(rng.randrange(14, 50))} {rng.choice(['token', 'of'])}" for _ in range(60)]
    texts += [texts[0] + " " + texts[0], f"dup={(k := key(19))},{k}"]
    rows = [(i, t, rng.choice([None, "web", "Tests/x", "src"])) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = secrets.candidates(frame)
    want = plain_candidates(rows)
    columns = ["doc_id", "word_index", "found", "prefix", "before", "after", "path"]
    assert sorted(tuple(r) for r in found.select(columns).collect()) == sorted(want)
    logs = [rng.uniform(-9, 0) for _ in range(28 * 28)]
    got = secrets.features(found.withColumn("f_coverage", F.lit(0.5)), spark.createDataFrame([(logs,)], "logs array<double>")).collect()
    for r in got:
        own = plain_features(r.found, r.prefix, r.before, r.after, r.path, logs)
        assert {k: r[k] for k in own} == pytest.approx(own), r
    assert {*own, "f_coverage"} == set(secrets.FEATURES)


def test_coverage_by_known_words(spark):
    found = ["userAccount99token12", "USERaccountXYZ1234567", "abc123def456ghi789", "resourceresource00"]
    known = {"user", "account", "resource"}
    rows = spark.createDataFrame([(f,) for f in found], "found string")
    got = {r.found: r.f_coverage for r in secrets.covered(rows, spark.createDataFrame([(w,) for w in known], "word string")).collect()}
    for f in found:
        runs = [x.lower() for x in re.findall("[A-Z]?[a-z]{2,}|[A-Z]{3,}", f)]
        assert got[f] == pytest.approx(sum(len(x) for x in runs if x in known) / len(f))

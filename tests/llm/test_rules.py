import random
import re

from strata.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen, dup = [], 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.append(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "\u00a0", "é\x1cü a\x0bb"]
    texts += ["".join(rng.choice(["the ", "cat ", "sat, ", "ünder\t", "$# ", "a\n", "b\r\n", "x\u2003y "]) for _ in range(rng.choice([3, 60, 200]))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(0, texts[9], "own")], "doc_id long, text string, RULES string")
    got = rules.apply_rules(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        v = r.rules
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == base(r.text)
        assert not (v.base_failed and v.kept)


def test_lines_and_verdict():
    prose = " ".join(f"word{i} and then, some{i} more." for i in range(20))
    assert rules.judge(prose.encode())[-2]
    menu = "Home | News | Sport | Weather | Shop | Travel"
    *_, kept, cleaned = rules.judge(f"{menu}\n{prose}\nAll rights reserved.\nNext >\n%%%% $$$$\n\n".encode())
    assert kept and cleaned == f"{prose}\n\n"  # lines without a word stay
    *_, kept, cleaned = rules.judge("\n".join([menu + str(i) for i in range(60)]).encode())
    assert not kept and cleaned == ""


def plain_fails(line, words):
    """The line rules, spelled out on characters."""
    if sum(c in "#*$%&|<>" for c in line) > 0.10 * sum(len(w.encode()) for w in words) or not any(c.isalnum() for c in line):
        return True
    if len(words) >= 3 and 3 * sum(line.count(c) for c in "|»›→•·") >= len(words):
        return True
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    if len(words) <= 3 and " ".join(low.split(" ")).strip("\t\r ").rstrip(" >:.!") in {x for own in rules.LINK_WORDS.values() for x in own.split(",")}:
        return True
    if any(x in low for own in rules.BOILERPLATE.values() for x in own):
        return True
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return len(words) >= 10 and len(hit) > 0.5 * len(words)


def test_verdicts_equal_brute_force():
    rng = random.Random(9)
    lines = ["Home | News | Sport", "Alle Rechte vorbehalten.", "Lire la suite", "Inicio", "Weiter >", "plain words, and more of them here", "the cat sat on a mat and went", "a b c " * 6, "$$ ## %%", "...", "é ü", "x #y", "Politica de privacidad", "Política de privacidad"]
    for _ in range(300):
        own = [rng.choice(lines[5:7]) + f" n{rng.random()}" if rng.random() < rng.choice([0.3, 0.7]) else rng.choice(lines) for _ in range(rng.choice([4, 10, 25]))]
        text = "\n".join(own)
        kept = [line for line in own if not plain_fails(line, WORD.findall(line))]
        size = lambda many: sum(len(w.encode()) for line in many for w in WORD.findall(line))
        n_kept = sum(len(WORD.findall(line)) for line in kept)
        *_, failed, good, cleaned = rules.judge(text.encode())
        assert cleaned == "\n".join(kept)
        assert failed == base(text)[-1] and good == (not failed and n_kept >= 50 and size(own) - size(kept) <= 0.40 * size(own))


def test_very_long_text_and_no_rows(spark):
    assert rules.judge(b"ab " * 400_000)[4] == 400_000
    assert rules.apply_rules(spark.createDataFrame([], "text string")).count() == 0

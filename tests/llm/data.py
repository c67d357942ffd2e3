"""A small table of awkward documents, and plain versions of what the operators compute."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, h long, kept boolean, score double"
LONG = " ".join(f"wort{i % 977} über, 12.{i}" for i in range(30_000))


def rows(seed=3, n=120):
    """Prose in two invented languages, with copies, near copies, nulls, empty and very long texts."""
    draw = random.Random(seed)
    words = {"aa": ["the", "of", "thing", "ing", "and", "shou", "ther", "wh"],
             "bb": ["der", "die", "über", "schön", "keit", "ung", "ß", "ach"]}
    out = []
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        text = " ".join(draw.choice(words[lang]) + draw.choice(words[lang]) for _ in range(draw.randint(30, 90)))
        out.append([i, text, lang, "hot" if i % 3 == 0 else f"s{i % 5}"])
    for i in range(0, 30, 3):
        out.append([n + i, out[i][1], out[i][2], "hot"])
        out.append([n + i + 1, "\t" + out[i][1].replace(" ", "\n "), out[i][2], None])
        out.append([n + i + 2, out[i][1] + " extra", out[i][2], "s1"])
    odd = [None, "", " \t\r\n", "a", "A.", "É é", "1234 5678", "你好 世界", LONG, "\x00\x1c x", "🙂 emoji 🙂"]
    out += [[10_000 + i, t, None, None] for i, t in enumerate(odd)]
    out += [out[0], out[0], [None, "no id here at all", "aa", "s1"], [None, "no id here at all", "aa", None], [None, None, None, None]]
    return [(i, t, lang, source, None, "x", 1, False, 0.5) for i, t, lang, source in out]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")

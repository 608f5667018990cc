"""Kana scalar functions as Column expressions over built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vowel rows of the kana table, small kana, silent symbols.
VOWEL_ROWS = {
    "ア": "アカサタナハマヤラワガザダバパァャヮ",
    "イ": "イキシチニヒミリギジヂビピィ",
    "ウ": "ウクスツヌフムユルグズヅブプヴゥュ",
    "エ": "エケセテネヘメレゲゼデベペェ",
    "オ": "オコソトノホモヨロヲゴゾドボポォョ",
}
SMALL_KANA = "ャュョァィゥェォヮ"
SMALL_VOWELS = "ァィゥェォヮぁぃぅぇぉゎ"
LARGE_VOWELS = "アイウエオワあいうえおわ"
LONG_MARK = "ー"
SILENT_SYMBOLS = "・･＝=゠:： 　"
PUNCTUATION = r"[\s、。,.!?！？・「」『』()（）〜~-]"

HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3097))
KATAKANA = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))
KANA_CLASS = "ぁ-ゖァ-ヺーゝゞヽヾ"
ROW_CHARS = "".join(VOWEL_ROWS.values())
ROW_VOWELS = "".join(v * len(chars) for v, chars in VOWEL_ROWS.items())


def _is_in(ch: Column, chars: str) -> Column:
    return (F.length(ch) > 0) & (F.instr(F.lit(chars), ch) > 0)


def vowel_of_char(ch: Column) -> Column:
    """Vowel row of one katakana character, null for others."""
    return F.when(_is_in(ch, ROW_CHARS), F.translate(ch, ROW_CHARS, ROW_VOWELS))


def to_katakana(text: Column) -> Column:
    return F.translate(text, HIRAGANA, KATAKANA)


def to_hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


def keep_kana(text: Column) -> Column:
    """Katakana reading: hiragana converted, everything but kana removed."""
    return F.regexp_replace(to_katakana(text), "[^ァ-ヺー]", "")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, "")


def strip_silent(text: Column) -> Column:
    return F.translate(text, SILENT_SYMBOLS, "")


def is_all_kana(text: Column) -> Column:
    return text.rlike(f"^[{KANA_CLASS}]*$")


def split_moras(kana: Column) -> Column:
    """Small kana and the long mark join the mora before them."""
    return F.regexp_extract_all(kana, F.lit(f"(?s).[{SMALL_KANA}{LONG_MARK}]*"), 0)


def split_fine_moras(kana: Column) -> Column:
    """Only small kana join the mora before them."""
    return F.regexp_extract_all(kana, F.lit(f"(?s).[{SMALL_KANA}]*"), 0)


def vowel_of(kana: Column) -> Column:
    """Vowel of the last character that is not a long mark."""
    return vowel_of_char(F.right(F.rtrim(kana, F.lit(LONG_MARK)), F.lit(1)))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: F.length(c) > 0)


def normalize_small_vowels(kana: Column) -> Column:
    """A small vowel with the vowel of the character before it becomes large."""

    def step(acc: Column, ch: Column) -> Column:
        is_small = _is_in(ch, SMALL_VOWELS)
        large = F.translate(ch, SMALL_VOWELS, LARGE_VOWELS)
        own = vowel_of_char(to_katakana(large))
        opened = is_small & (acc["prev"].isNull() | (acc["prev"] == own))
        shown = F.when(opened, large).otherwise(ch)
        prev = F.when(shown == LONG_MARK, acc["prev"]).otherwise(vowel_of_char(to_katakana(shown)))
        return F.struct(prev.alias("prev"), F.concat(acc["out"], shown).alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("prev"), F.lit("").alias("out"))
    return F.aggregate(_chars(kana), start, step, lambda acc: acc["out"])


def open_long_vowel_runs(kana: Column) -> Column:
    """From the second long mark of a run on, write the vowel being held."""

    def step(acc: Column, ch: Column) -> Column:
        repeat = (ch == LONG_MARK) & (acc["last"] == LONG_MARK)
        shown = F.when(repeat, F.coalesce(acc["vowel"], ch)).otherwise(ch)
        vowel = F.when(ch == LONG_MARK, acc["vowel"]).otherwise(vowel_of_char(ch))
        return F.struct(
            ch.alias("last"), vowel.alias("vowel"), F.concat(acc["out"], shown).alias("out")
        )

    start = F.struct(
        F.lit("").alias("last"), F.lit(None).cast("string").alias("vowel"), F.lit("").alias("out")
    )
    return F.aggregate(_chars(kana), start, step, lambda acc: acc["out"])


def normalize_long_vowels(kana: Column) -> Column:
    """Spelled-out long vowels become the long mark, one character for one."""

    def step(acc: Column, ch: Column) -> Column:
        before = F.right(acc, F.lit(1))
        vowel = vowel_of_char(before)
        lengthens = (
            ((ch == "ウ") & vowel.isin("オ", "ウ"))
            | ((ch == "イ") & vowel.isin("エ", "イ"))
            | (_is_in(ch, "アイウエオ") & (vowel == ch))
        )
        return F.concat(acc, F.when(F.coalesce(lengthens, F.lit(False)), LONG_MARK).otherwise(ch))

    return F.aggregate(_chars(kana), F.lit(""), step)


def spelling_key(text: Column) -> Column:
    """Comparison form of a reading: no punctuation, one way to write long vowels."""
    return to_hiragana(normalize_long_vowels(to_katakana(strip_punctuation(text))))


def needs_ruby(surface: Column, kana: Column) -> Column:
    bare = strip_silent(surface)
    differs = normalize_long_vowels(to_katakana(bare)) != normalize_long_vowels(to_katakana(kana))
    return (F.length(surface) > 0) & (F.length(kana) > 0) & ~is_all_kana(bare) & differs


def script_runs(text: Column) -> Column:
    """Array of maximal runs of kana (with silent symbols) and of other characters."""
    cls = KANA_CLASS + SILENT_SYMBOLS
    return F.regexp_extract_all(text, F.lit(f"(?s)[{cls}]+|[^{cls}]+"), 0)


def is_kana_run(run: Column) -> Column:
    return run.rlike(f"^[{KANA_CLASS}{SILENT_SYMBOLS}]")


def ruby_readings(surface: Column, kana: Column) -> Column:
    """Readings of the non-kana runs of ``surface`` in order; null if they do not fit."""
    runs = script_runs(surface)
    n_other = F.size(F.filter(runs, lambda r: ~is_kana_run(r)))
    anchored = F.exists(runs, lambda r: is_kana_run(r) & (F.length(strip_silent(r)) > 0))

    def fit(normalize) -> Column:
        def piece(r: Column) -> Column:
            literal = normalize(to_katakana(strip_silent(r)))
            return F.when(is_kana_run(r), literal).otherwise(F.lit("(.+?)"))

        pattern = F.concat(F.lit("^"), F.array_join(F.transform(runs, piece), ""), F.lit("$"))
        target = normalize(to_katakana(kana))
        groups = F.transform(
            F.sequence(F.lit(1), F.greatest(n_other, F.lit(1))),
            lambda i: F.when(i <= n_other, F.call_function("regexp_extract", target, pattern, i)),
        )
        return F.when(F.regexp_like(target, pattern), F.array_compact(groups))

    usable = (F.length(surface) > 0) & (F.length(kana) > 0) & ((n_other <= 1) | anchored)
    return F.when(usable, F.coalesce(fit(lambda c: c), fit(normalize_long_vowels)))


# Fixed form of a forced reading: a bar, the text, the reading in double brackets.
RUBY = "｜([^｜《》]+)《([^《》]*)》"


def strip_ruby(text: Column) -> Column:
    return F.regexp_replace(text, RUBY, "$1")


def ruby_segments(text: Column) -> Column:
    """Array of (text, forced reading or null) pieces; joined texts give ``strip_ruby``."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){RUBY}|(?:(?!{RUBY}).)+"), 0)
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.regexp_replace(p, RUBY, "$1").alias("text"),
            F.when(p.rlike(f"^{RUBY}$"), F.regexp_extract(p, RUBY, 2)).alias("reading"),
        ),
    )


# Moras sung on the attack of the one before, and characters that hold a note.
TAIL_MORAS = ("ン", "ッ")
HOLDING = "ァィゥェォー"


def note_attacks(kana: Column) -> Column:
    """How many moras of a note start a sound of their own (at least one)."""
    moras = split_moras(kana)
    shifted = F.concat(F.array(F.lit("")), moras)
    tails = F.zip_with(
        moras,
        F.slice(shifted, F.lit(1), F.size(moras)),
        lambda m, prev: F.when(
            (prev != "")
            & (m.isin(*TAIL_MORAS) | (m.isin("イ", "ウ") & vowel_of(prev).isNotNull())),
            0,
        ).otherwise(1),
    )
    return F.greatest(F.lit(1), F.aggregate(tails, F.lit(0), lambda a, b: a + b))


def held_note(kana: Column) -> Column:
    """One syllable stretched by small vowels or long marks."""
    return kana.rlike(f"^(?s:.)[{HOLDING}]+$")


def dropout_flags(moras: Column) -> Column:
    """Moras that tend to vanish: tails, long marks, bare i after an e, bare u after an o."""
    shifted = F.concat(F.array(F.lit("")), moras)
    return F.zip_with(
        moras,
        F.slice(shifted, F.lit(1), F.size(moras)),
        lambda m, prev: m.isin("ッ", "ン", "ー")
        | ((m == "イ") & F.coalesce(vowel_of(prev) == "エ", F.lit(False)))
        | ((m == "ウ") & F.coalesce(vowel_of(prev) == "オ", F.lit(False))),
    )


def singer_moras(kana: Column) -> Column:
    """Moras for a singer that knows no long mark: it becomes the held vowel.

    A small vowel that repeats the vowel before it also becomes a mora of its own.
    """
    small, large = SMALL_VOWELS[:6], LARGE_VOWELS[:6]

    def split_small(base: Column) -> Column:
        # Trailing small vowels of the mora's own vowel, written large.
        tail = F.regexp_extract(base, f"[{small}]+$", 0)
        tail_chars = F.reverse(_chars(tail))
        kept = F.aggregate(
            tail_chars,
            F.struct(base.alias("head"), F.lit("").alias("tail"), F.lit(True).alias("open")),
            lambda acc, ch: F.when(
                acc["open"]
                & (F.length(acc["head"]) > 1)
                & F.coalesce(
                    vowel_of(F.left(acc["head"], F.length(acc["head"]) - 1))
                    == F.translate(ch, small, large),
                    F.lit(False),
                ),
                F.struct(
                    F.left(acc["head"], F.length(acc["head"]) - 1).alias("head"),
                    F.concat(F.translate(ch, small, large), acc["tail"]).alias("tail"),
                    F.lit(True).alias("open"),
                ),
            ).otherwise(
                F.struct(acc["head"].alias("head"), acc["tail"].alias("tail"), F.lit(False).alias("open"))
            ),
        )
        return F.concat(F.array(kept["head"]), _chars(kept["tail"]))

    def expand(mora: Column) -> Column:
        base = F.rtrim(mora, F.lit(LONG_MARK))
        longs = F.length(mora) - F.length(base)
        held = F.array_repeat(F.coalesce(vowel_of(base), F.lit("ア")), longs)
        return F.when(F.length(base) > 0, F.concat(split_small(base), held)).otherwise(
            F.array_repeat(F.lit("ア"), longs)
        )

    return F.flatten(F.transform(split_moras(kana), expand))


def compressed_counts(kana: Column, pronunciation: Column) -> Column:
    """Per pronunciation element, the moras the trailing long marks stand for.

    ``pronunciation`` elements are consecutive pieces of the word in which some
    moras were folded into a long mark. Null if the pieces do not rebuild the word.
    """
    fines = split_fine_moras(kana)
    absorbable = ("ン", "ッ", "ー", "ア", "イ", "ウ", "エ", "オ")

    def step(acc: Column, p: Column) -> Column:
        head = F.rtrim(p, F.lit(LONG_MARK))
        n_head = F.size(split_fine_moras(head))
        n_long = F.length(p) - F.length(head)
        at = acc["at"]
        got = F.array_join(F.slice(fines, at + 1, n_head), "")
        swallowed = F.slice(fines, at + 1 + n_head, n_long)
        ok = acc["ok"] & (got == head) & (F.size(swallowed) == n_long) & F.forall(
            swallowed, lambda m: m.isin(*absorbable)
        )
        return F.struct(
            (at + n_head + n_long).alias("at"),
            ok.alias("ok"),
            F.concat(
                acc["out"], F.array(F.array_join(F.filter(swallowed, lambda m: m != LONG_MARK), ""))
            ).alias("out"),
        )

    start = F.struct(
        F.lit(0).alias("at"), F.lit(True).alias("ok"), F.array().cast("array<string>").alias("out")
    )
    done = F.aggregate(pronunciation, start, step)
    return F.when(done["ok"] & (done["at"] == F.size(fines)), done["out"])




# Consonant of each kana row; vowels have none.
CONSONANT_ROWS = {
    "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ",
    "m": "マミムメモ", "y": "ヤユヨャュョ", "r": "ラリルレロ", "w": "ワヲヮ", "g": "ガギグゲゴ",
    "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ", "v": "ヴ",
}


def consonant_of(mora: Column) -> Column:
    """Consonant class of a mora's first character, empty for vowels and signs."""
    chars = "".join(CONSONANT_ROWS.values())
    names = "".join(c * len(row) for c, row in CONSONANT_ROWS.items())
    first = F.left(mora, F.lit(1))
    return F.when(_is_in(first, chars), F.translate(first, chars, names)).otherwise("")

"""Column functions over base letters, k-mers and record headers.

k-mers are right-aligned longs of two bits a base (A 0, C 1, G 2, T 3), so their order
is that of the letters and k is at most 31; a missing k-mer is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of the sixteen codes, in the order of their numbers.
IUPAC = "ACGTNRYSWKMBDHVU"
#: Code of any other letter.
UNKNOWN = 30
MAX_K = 31


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be 1 to {MAX_K}, not {k}")
    return k


def sample_of(header: Column) -> Column:
    """The first two parts of a header of three or more, else 'unknown'."""
    parts = F.split(header, "#")
    return F.when(F.size(parts) >= 3, F.concat_ws("#", parts[0], parts[1])).otherwise(F.lit("unknown"))


def contig_of(header: Column) -> Column:
    """What follows the sample in a header of three or more parts, else all of it."""
    parts = F.split(header, "#")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "#")).otherwise(header)


def sample_of_two(header: Column) -> Column:
    """The first two parts of a header of two or more, else null."""
    parts = F.split(header, "#")
    return F.when(F.size(parts) >= 2, F.concat_ws("#", parts[0], parts[1]))


def first_word(header: Column) -> Column:
    return F.split(F.trim(header), r"\s+")[0]


def file_sample(name: Column) -> Column:
    """A file's name without the endings of sequence files."""
    return F.regexp_replace(F.regexp_replace(name, r"[.]gz$", ""), r"[.](?:fa|fasta|fna)$", "")


def size_of(text: Column) -> Column:
    """Bytes of '512M', '2G', '64K' or a plain number; null for anything else."""
    number = F.try_to_number(F.regexp_extract(text, r"^([0-9]+)([KkMmGg]?)$", 1), F.lit("999999999999999999")).cast("long")
    unit = F.upper(F.regexp_extract(text, r"^([0-9]+)([KkMmGg]?)$", 2))
    return number * F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)


def base_code(letter: Column) -> Column:
    """0 to 3 for A, C, G, T in any case, else null."""
    at = F.instr(F.lit("ACGT"), F.upper(letter))
    return F.when((F.length(letter) == 1) & (at > 0), at - 1)


def base_letter(code: Column) -> Column:
    return F.when(code.between(0, 3), F.substr(F.lit("ACGT"), code + 1, F.lit(1)))


def complement_code(code: Column) -> Column:
    """3 minus a base's code; every other code becomes 4."""
    return F.when(code < 4, 3 - code).otherwise(4)


def clean(raw: Column) -> Column:
    """Letters as scans keep them: codes above 64 and below 128, upper case."""
    return F.upper(F.regexp_replace(raw, r"[^\x41-\x7F]", ""))


def iupac_code(letter: Column) -> Column:
    """The number of a letter among the sixteen, 32 for a backtick, else 30."""
    at = F.instr(F.lit(IUPAC), F.upper(letter))
    return F.when(letter == "`", 32).when(at > 0, at - 1).otherwise(UNKNOWN)


def code_letter(code: Column) -> Column:
    """The letter of a code below 16, else N."""
    return F.when(code.between(0, 15), F.substr(F.lit(IUPAC), code + 1, F.lit(1))).otherwise(F.lit("N"))


def only_bases(text: Column, also: str = "") -> Column:
    """The letters A, C, G and T of a text (and ``also``), upper case."""
    return F.regexp_replace(F.upper(text), f"[^ACGT{also}]", "")


def reverse_complement(seq: Column) -> Column:
    """Other letters than A, C, G, T keep their letter and change their place."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def kmer_of(word: Column) -> Column:
    """A word of A, C, G, T as a number; null if it holds another letter."""
    return F.when(F.rlike(word, F.lit("^[ACGT]+$")), F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("long"))


def word_of(kmer: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), check_k(k), "0"), "0123", "ACGT")


def reverse_kmer(kmer: Column, k: int) -> Column:
    digits = F.lpad(F.conv(kmer.cast("string"), 10, 4), check_k(k), "0")
    return F.conv(F.reverse(F.translate(digits, "0123", "3210")), 4, 10).cast("long")


def canonical(kmer: Column, k: int) -> Column:
    return F.least(kmer, reverse_kmer(kmer, k))


def is_direct(kmer: Column, k: int) -> Column:
    return kmer <= reverse_kmer(kmer, k)


def kmer_at(seq: Column, pos: Column, k: int) -> Column:
    """The k-mer that begins at ``pos`` (from 0); null if it does not fit or holds
    another letter than A, C, G, T.
    """
    word = F.substr(seq, (pos + 1).cast("int"), F.lit(check_k(k)))
    return F.when((pos >= 0) & (pos + k <= F.length(seq)), kmer_of(word))


def symbol_at(kmer: Column, place: Column, k: int) -> Column:
    """The base of a k-mer at ``place`` (from 0, the left)."""
    return F.call_function("shiftright", kmer, (2 * (check_k(k) - 1 - place)).cast("int")).bitwiseAND(F.lit(3).cast("long"))


def valid_bases(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^ACGT]", ""))


def split_before(pos: Column, k: int) -> Column:
    """Where the piece that follows a split at ``pos`` begins."""
    return F.greatest(pos + 1 - k, F.lit(0))


def split_half_down(left: Column, k: int) -> Column:
    """Second piece's begin when half of k, rounded down, goes left."""
    return F.greatest(left - k // 2, F.lit(0))


def split_half_up(pos: Column, k: int) -> Column:
    """Second piece's begin when half of k, rounded up, goes left (splits of segments)."""
    return F.greatest(pos - (k + 1) // 2, F.lit(0))


def normal_pair(a: Column, b: Column) -> Column:
    """The two k-mers by order, a missing one last."""
    return F.when(a.isNull() | (b < a), F.struct(b.alias("lo"), a.alias("hi"))).otherwise(F.struct(a.alias("lo"), b.alias("hi")))


def zigzag(value: Column) -> Column:
    return F.when(value >= 0, 2 * value).otherwise(-2 * value - 1)


def unzigzag(value: Column) -> Column:
    return F.when(value % 2 == 0, F.floor(value / 2)).otherwise(-F.floor((value + 1) / 2)).cast("long")


def zigzag_against(value: Column, before: Column) -> Column:
    """A non-negative value told by its predecessor: near ones are small numbers, and
    those from twice the predecessor on stay what they are.
    """
    return F.when(value >= 2 * before, value).when(value >= before, 2 * (value - before)).otherwise(2 * (before - value) - 1)


# The digits of numbers in stream names, in order.
NAME_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_#"


def number_name(value: Column) -> Column:
    """A number of up to 36 bits in base 64, lowest digit first."""
    places = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: (i == 0) | (F.call_function("shiftright", value, 6 * i) > 0))
    return F.array_join(F.transform(places, lambda i: F.substr(F.lit(NAME_DIGITS), (F.call_function("shiftright", value, 6 * i).bitwiseAND(F.lit(63).cast("long")) + 1).cast("int"), F.lit(1))), "")


def name_number(name: Column) -> Column:
    digits = F.split(F.reverse(name), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, c: acc * 64 + F.instr(F.lit(NAME_DIGITS), c) - 1)


def stream_name(group: Column, part: str, version: int = 3000) -> Column:
    """Name of a group's reference ('ref') or delta ('delta') stream."""
    if version < 3000:
        return F.concat(F.lit("seg-"), group.cast("string"), F.lit(f"-{part}"))
    return F.concat(F.lit("x"), number_name(group), F.lit(part[0]))


def repetitiveness(seq: Column) -> Column:
    """Over lags 4 to 31, the pairs of equal letters at that lag by the pairs whose first
    is a base: the share at the first lag where it is a half or more, else the largest.
    """
    letters = F.split(seq, "")

    def share(lag: Column) -> Column:
        n = F.greatest(F.size(letters) - lag, F.lit(0))
        a, b = F.slice(letters, 1, n), F.slice(letters, lag + 1, n)
        same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
        return F.coalesce(F.try_divide(same, F.size(F.filter(a, lambda x: F.contains(F.lit("ACGT"), x)))), F.lit(0.0))

    shares = F.transform(F.sequence(F.lit(4), F.lit(31)), lambda lag: F.when(F.size(letters) > lag, share(lag)).otherwise(0.0))
    return F.coalesce(F.get(F.filter(shares, lambda x: x >= 0.5), F.lit(0)), F.array_max(shares))

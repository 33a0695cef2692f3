"""French street text as column expressions, all inside whole-stage code generation.

Every rewrite refers to its input once, so a chain of them stays a chain (an expression that names its input twice would
double the plan with each step).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what stands for them; the ligatures become two letters.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
LIGATURES = {"Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae"}

# Rewrites of a street's beginning, then of abbreviated words, in order.
STREET_REWRITES = (
    (r"^/+\s*", ""),
    (r"^ET\s+", ""),
    (r"^PARKING\s+VINCI/ROSSINI\s+\d+\s+", ""),
    (r"^R[.\s]+", "RUE "),
    (r"^BD[.\s]+", "BOULEVARD "),
    (r"^BLD[.\s]+", "BOULEVARD "),
    (r"^AV(?:E)?[.\s]+", "AVENUE "),
    (r"^PL[.\s]+", "PLACE "),
    (r"^PAS[.\s]+", "PASSAGE "),
    (r"^IMP[.\s]+", "IMPASSE "),
    (r"^SQ[.\s]+", "SQUARE "),
    (r"\bFBG\b", "FAUBOURG"),
    (r"\bFG\b", "FAUBOURG"),
    (r"\bST\b", "SAINT"),
    (r"\bSTE\b", "SAINTE"),
)

# What may follow a house number that is dropped.
NUMBERED_TYPES = ("RUE ", "R. ", "R ", "BD ", "BOULEVARD ", "AV ", "AVENUE ", "PL ", "PLACE ", "PAS ", "PASSAGE ", "IMP ", "IMPASSE ", "SQ ", "SQUARE ", "VILLA ", "CITE ", "EGLISE ")

# Words that a title keeps small unless they come first.
SMALL_WORDS = ("a", "au", "aux", "d", "de", "des", "du", "et", "l", "la", "le", "les")

#: White space as the reference dialect has it; Java's \s knows the ASCII part only.
SPACES = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
HOUSE_NUMBER = r"^\d+(?:[.\s]\d+)*[A-Z]?\s+"


def trim(c: Column) -> Column:
    """Both ends freed of any white space, the no-break space included."""
    return F.regexp_replace(c, rf"^{SPACES}+|{SPACES}+$", "")


def strip_accents(c: Column) -> Column:
    """Accents folded by the fixed table (capital Y with diaeresis stays)."""
    out = F.translate(c, ACCENTED, PLAIN)
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


def fold_key(c: Column) -> Column:
    """The lookup key of a name or query: trimmed, accent-free, upper case."""
    return F.upper(strip_accents(trim(c)))


def _ascii_words(pattern: str) -> str:
    """Word borders by ASCII letters; Java's border also sees accented letters."""
    if not pattern.startswith(r"\b"):
        return pattern
    return r"(?<![A-Za-z0-9_])" + pattern[2:-2] + r"(?![A-Za-z0-9_])"


def _strip_house_number(c: Column) -> Column:
    types = "|".join(t.replace(".", r"\.") for t in NUMBERED_TYPES)
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^/+\s*", ""), f"{HOUSE_NUMBER}(?={types})", "")


def normalize_street(c: Column) -> Column:
    """Street name in full words, upper case, without accents, parentheses and a leading house number; null stays null."""
    out = F.regexp_replace(F.upper(strip_accents(c)), r"[()]", " ")
    out = F.trim(F.regexp_replace(out, f"{SPACES}+", " "))
    for pattern, words in STREET_REWRITES:
        out = _strip_house_number(F.regexp_replace(out, _ascii_words(pattern), words))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title_case(c: Column) -> Column:
    """Words capitalised at their first letter only; small words stay small unless first."""
    words = F.filter(F.split(F.lower(c), f"{SPACES}+"), lambda w: w != "")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(capital(w))), " ")


def parse_location(location: Column, fallback_city: Column) -> Column:
    """``struct<label, name, key, city, postcode>`` of "street, city (postcode)"; null counts as empty."""
    location, fallback_city = F.coalesce(location, F.lit("")), F.coalesce(fallback_city, F.lit(""))
    comma = F.locate(",", location)
    street = trim(F.when(comma > 0, F.substring_index(location, ",", 1)).otherwise(location))
    city = trim(F.when(comma > 0, F.substring(location, comma + 1, F.length(location))).otherwise(fallback_city))
    in_city = F.regexp_extract(city, r"\(([0-9]{5})\)", 1)
    in_street = F.regexp_extract(street, r"(?<![A-Za-z0-9_])(75[0-9]{3})(?![A-Za-z0-9_])", 1)
    bare = trim(F.regexp_replace(city, r"\([^)]*\)", ""))
    city = F.coalesce(F.nullif(bare, F.lit("")), F.nullif(fallback_city, F.lit("")), F.lit("Paris"))
    parts = lambda name: F.struct(title_case(name).alias("label"), name.alias("name"), F.upper(strip_accents(name)).alias("key"), title_case(city).alias("city"), F.coalesce(F.nullif(in_city, F.lit("")), in_street).alias("postcode"))
    # as an argument the name is there once, not as a chain of rewrites in each of the parts
    return F.get(F.transform(F.array(normalize_street(street)), parts), F.lit(0))


def street_id(parsed: Column) -> Column:
    """The street's key: name, postcode and city, upper case and accent-free, with bars between."""
    return F.concat_ws("|", parsed["key"], parsed["postcode"], F.upper(strip_accents(parsed["city"])))


def lookup_query(name: Column, city: Column, postcode: Column) -> Column:
    """The text a street is geocoded by."""
    return trim(F.concat_ws(" ", name, city, postcode))


def department_code(code: Column) -> Column:
    """Three characters for overseas codes (97 and 98), else two."""
    return F.when(F.rlike(code, F.lit("^9[78].")), F.substring(code, 1, 3)).otherwise(F.substring(code, 1, 2))


def postal_label(name: Column, postcodes: Column) -> Column:
    """Name and first postcode."""
    return trim(F.concat_ws(" ", name, F.get(postcodes, F.lit(0))))


def variant_pattern(key: Column) -> Column:
    """A regular expression for a name key: letters with their accented forms, any separator between words."""
    # Accented forms of each letter, and what may stand between words.
    forms = {"A": "[AÀÁÂÃÄÅàáâãäå]", "C": "[CÇç]", "E": "[EÈÉÊËèéêë]", "I": "[IÌÍÎÏìíîï]", "N": "[NÑñ]", "O": "[OÒÓÔÕÖòóôõö]", "U": "[UÙÚÛÜùúûü]", "Y": "[YÝŸýÿ]"}
    between = "[ ./'’-]+"
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    special = F.array(*[F.lit(x) for x in "\\^$.*+?()[]{}|"])

    def one(ch: Column) -> Column:
        return F.coalesce(F.try_element_at(table, ch), F.when(F.array_contains(special, ch), F.concat(F.lit("\\"), ch)).otherwise(ch))

    words = F.filter(F.split(trim(key), f"{SPACES}+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.split(w, ""), one), "")), between)


def plural(n: Column, word: str) -> Column:
    """Count and word, with an s from two on."""
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))


# The French words and sentences of the four functions below.


def summary_text(city: Column, postcode: Column, incident_ids: Column) -> Column:
    """Place and number of incidents; empty parts are left out."""
    place = F.concat_ws(" ", F.nullif(city, F.lit("")), F.nullif(postcode, F.lit("")))
    n = F.size(incident_ids)
    return F.concat_ws(" · ", F.nullif(place, F.lit("")), F.when(n > 0, plural(n, "coupure")))


def restore_text(restore_at: Column, has_lines: Column, geocode_status: Column) -> Column:
    """Expected restoration, and a note for streets with neither lines nor a point."""
    unplaced = ~F.coalesce(has_lines, F.lit(False)) & ~F.coalesce(geocode_status == "ok", F.lit(False))
    return F.concat_ws(" · ", F.when(restore_at != "", F.concat(F.lit("retour "), restore_at)), F.when(unplaced, F.lit("non géocodée")))


def detail_text(summary: Column, restore: Column) -> Column:
    return F.concat_ws(" · ", F.nullif(summary, F.lit("")), F.nullif(restore, F.lit("")))


def group_digits(n: Column) -> Column:
    """French digit groups, set apart by narrow no-break spaces."""
    return F.replace(F.format_number(F.coalesce(n, F.lit(0)), 0), F.lit(","), F.lit("\u202f"))


def status_text(streets: Column, with_lines: Column, geocoded: Column, communes: Column, total: Column, source: str) -> Column:
    """One sentence on a page of results; ``source`` names who reported them."""
    some = F.when(communes < total, F.concat(F.lit(" dans "), group_digits(communes), F.lit(" communes sur "), group_digits(total)))
    suffix = F.when(communes > 1, F.coalesce(some, F.concat(F.lit(" dans "), group_digits(communes), F.lit(" communes")))).otherwise(F.lit(""))
    reported = F.concat(group_digits(streets), F.lit(f" rues remontées par {source}"), suffix)
    return (
        F.when(streets == 0, F.concat(F.lit(f"Aucune rue touchée remontée par {source} dans les communes visibles"), suffix, F.lit(".")))
        .when(with_lines > 0, F.concat(group_digits(with_lines), F.lit(" rues surlignées sur "), reported))
        .when(geocoded == 0, F.concat(reported, F.lit(". Zoomez pour afficher les tracés.")))
        .otherwise(F.concat(group_digits(geocoded), F.lit(" rues placées sur "), reported))
    )

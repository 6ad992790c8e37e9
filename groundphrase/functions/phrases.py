"""Class names, phrases and their features as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class names and what phrases call them.
CLASS_NAMES = {
    "Large_Vehicle": "large vehicle",
    "Small_Vehicle": "small vehicle",
    "storage_tank": "storage tank",
    "plane": "plane",
    "ship": "ship",
    "Swimming_pool": "swimming pool",
    "Harbor": "harbor",
    "tennis_court": "tennis court",
    "Ground_Track_Field": "ground track field",
    "Soccer_ball_field": "soccer ball field",
    "baseball_diamond": "baseball diamond",
    "Bridge": "bridge",
    "basketball_court": "basketball court",
    "Roundabout": "roundabout",
    "Helicopter": "helicopter",
}
#: Words that show a phrase's features; substrings count.
FEATURE_WORDS = {
    "category": ["small vehicle", "large vehicle", "ship", "building", "storage tank", "harbor", "swimming pool",
                 "tennis court", "soccer ball field", "roundabout", "basketball court", "bridge", "ground track field",
                 "plane", "helicopter", "water", "barren land", "agricultural area", "agricultural land", "forest area",
                 "road", "baseball diamond"],
    "position": ["in the top left", "in the top center", "in the top right", "in the center left", "in the center",
                 "in the center right", "in the bottom left", "in the bottom center", "in the bottom right"],
    "extreme": ["topmost", "bottommost", "leftmost", "rightmost"],
    "size": ["largest", "smallest"],
    "color": ["light", "dark", "red", "orange", "yellow", "green", "cyan", "blue", "purple", "magenta"],
    "relationship": ["that is to the left of", "that is to the bottom left of", "that is below",
                     "that is to the bottom right of", "that is to the right of", "that is to the top right of",
                     "that is above", "that is to the top left of"],
}
CHROMATIC = [c for c in FEATURE_WORDS["color"] if c not in ("light", "dark")]
#: Phrases of land-cover classes.
LANDCOVER_PHRASES = {
    "building": "all buildings in the image",
    "water": "all water in the image",
    "barren": "all barren land in the image",
    "forest": "all forest areas in the image",
    "agriculture": "all agricultural land in the image",
}


def pluralize(word: Column) -> Column:
    return (
        F.when(F.endswith(word, F.lit("y")), F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies")))
        .when(word.rlike("(s|sh|ch)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def standardize_class(name: Column, plural: bool = False) -> Column:
    """The name that phrases use; unknown names in lower case."""
    known = F.create_map(*[F.lit(x) for pair in CLASS_NAMES.items() for x in pair])
    out = F.lower(F.coalesce(F.try_element_at(known, name), name))
    return pluralize(out) if plural else out


def _plural_word(word: str) -> str:
    return word[:-1] + "ies" if word.endswith("y") else word + ("es" if word.endswith(("s", "sh", "ch")) else "s")


def standardize_phrase(phrase: Column) -> Column:
    """Class names become words, "group of 1 X" becomes X, larger groups and "all" take the plural, lower case."""
    out = F.lower(phrase)
    for name, said in CLASS_NAMES.items():
        if name.lower() != said:
            out = F.regexp_replace(out, rf"\b{name.lower()}\b", said)
    words = list(CLASS_NAMES.values())
    out = F.regexp_replace(out, rf"\bgroup of 1 ({'|'.join(words)})\b", "$1")
    endings: dict[str, list[str]] = {}
    for w in words:
        many = _plural_word(w)
        stem = len(w) if many.startswith(w) else len(w) - 1
        endings.setdefault(many[stem:], []).append(w[:stem] + (f"(?:{w[stem:]})" if stem < len(w) else ""))
    for ending, forms in endings.items():
        out = F.regexp_replace(out, rf"\b(group of (?!0*[01] )\d+ (?:{'|'.join(forms)}))\b", f"$1{ending}")
        out = F.regexp_replace(out, rf"\b(all (?:{'|'.join(forms)}))\b", f"$1{ending}")
    return out


def _telling(words: list[str]) -> list[str]:
    """Words that hold no other word of the list: a phrase that holds any of the list holds one of these."""
    return [w for w in words if not any(o in w and o != w for o in words)]


def phrase_features(phrase: Column) -> dict[str, Column]:
    """Whether each kind of feature occurs. Plain searches for words on bytes: alternatives of a pattern would be tried anew at
    every letter."""
    low = F.lower(phrase)
    return {
        name: F.coalesce(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in _telling(words)]), F.lit(False))
        for name, words in FEATURE_WORDS.items()
    }


def feature_combo(phrase: Column) -> Column:
    """Names of the features that occur, joined by "_"."""
    return F.concat_ws("_", *[F.when(on, name) for name, on in phrase_features(phrase).items()])


def suppress_colours(category: Column, colours: Column) -> Column:
    """Buildings and water have light and dark only."""
    plain = F.filter(colours, lambda c: ~c.isin(CHROMATIC))
    return F.when(F.lower(category).isin("building", "water"), plain).otherwise(colours)


def phrase_variants(phrase: Column, options: Column, pattern: str, before: str, after: str = "") -> Column:
    """The phrase once for each option, put where the pattern (greedy) matches."""
    return F.transform(
        options, lambda o: F.regexp_replace(phrase, F.lit(pattern), F.concat(F.lit(before), o, F.lit(after)))
    )


def position_variants(phrase: Column, positions: Column) -> Column:
    return phrase_variants(phrase, positions, r"in the [^,]+", "in the ")


def relation_variants(phrase: Column, directions: Column) -> Column:
    return phrase_variants(phrase, directions, r"that is [^,]+ a", "that is ", " a")


def landcover_phrase(category: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANDCOVER_PHRASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, category), F.concat(F.lit("all "), category, F.lit(" in the image")))


def drop_colour_words(phrase: Column) -> Column:
    """Whether a phrase names no colour as a word."""
    words = F.array(*map(F.lit, ["light", "dark", *CHROMATIC]))
    return ~F.arrays_overlap(F.split(F.lower(phrase), " "), words)


def llm_mode(name: Column, kind: Column) -> Column:
    """How an item is shown to a model: D always by its mask, L by its mask for groups, all else by its box."""
    mask = name.startswith("D") | name.startswith("L") & (kind == "group")
    return F.when(mask, "mask_dual").otherwise("bbox_dual")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def is_ascii(text: Column) -> Column:
    return F.regexp_replace(text, " ", "").rlike(r"^[\x00-\x7F]*$")


def sample_kind(ids: Column) -> Column:
    return F.when(F.size(ids) > 1, "group").otherwise("individual")


#: Sources by the first letter of their files' names.
DOMAINS = {"P": "iSAID", "L": "LoveDA", "D": "DeepGlobe"}


def domain_of(name: Column, default: str = "Unknown") -> Column:
    """The source of a file from the first letter of its base name, in either case; folders before it don't matter."""
    out, first = F.lit(default), F.upper(F.regexp_extract(name, r"([^/\\])[^/\\]*$", 1))
    for letter, domain in DOMAINS.items():
        out = F.when(first == letter, domain).otherwise(out)
    return out


def transform_suffix(domain: Column) -> Column:
    """What names of pictures in the style of a source end in."""
    out = F.lit("_unk")
    for letter, known in DOMAINS.items():
        out = F.when(domain == known, f"_to{letter}").otherwise(out)
    return out


def parse_patch_name(name: Column) -> list[Column]:
    """Image id and number of a patch file."""
    return [
        F.regexp_extract(name, r"^(.*?)_patch_", 1).alias("image"),
        F.regexp_extract(name, r"_patch_(\d+)", 1).try_cast("int").alias("patch_number"),
    ]


def parse_target_uri(uri: Column) -> list[Column]:
    """Image, kind and id of the target that a stored picture shows."""
    pattern = r"([^/]+)_(object|group)_(\d+)\.[a-z]+$"
    return [
        F.regexp_extract(uri, pattern, 1).alias("image"),
        F.regexp_extract(uri, pattern, 2).alias("kind"),
        F.regexp_extract(uri, pattern, 3).try_cast("bigint").alias("target_id"),
    ]

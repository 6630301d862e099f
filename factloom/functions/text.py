"""Text functions of the corpus preparation as Column expressions; ids of the survey in brackets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Special tokens in the order of their ids, and short function words that context features leave out.
SPECIALS = ["_pad", "_unk", "_go", "_eos"]
PAD, UNK, GO, EOS = range(4)
STOPWORDS = "a an the of in on at by to for from with and or but as is are was were be been".split()


def stem(c: Column) -> Column:
    """Each digit becomes 0, then lower case."""
    return F.lower(F.regexp_replace(c, r"\d", "0"))


def mask_entities(text: Column, a: Column, b: Column) -> Column:
    """All occurrences of the first name become ``_enta``, then those of the second ``_entb``; literal, in that order. An empty
    or null name masks nothing."""
    blank = lambda n: F.when(F.length(n) > 0, n)
    one = F.coalesce(F.replace(text, blank(a), F.lit("_enta")), text)
    return F.coalesce(F.replace(one, blank(b), F.lit("_entb")), one)


def tokens(c: Column) -> Column:
    """Split at white space, empty tokens dropped."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def vectorize(words: Column, ids: Column, go: bool = False, eos: bool = False) -> Column:
    """Ids of words by the map ``ids``; unknown words get the id of ``_unk``."""
    out = F.transform(words, lambda w: F.coalesce(F.try_element_at(ids, w), F.lit(UNK)))
    parts = ([F.array(F.lit(GO))] if go else []) + [out] + ([F.array(F.lit(EOS))] if eos else [])
    return F.concat(*parts) if len(parts) > 1 else out


#: Entries of a vocabulary that is sent to the workers, at most.
MAX_VOCABULARY = 4_000_000


def vectorizer(vocab: list[tuple[str, int]], go: bool = False, eos: bool = False):
    """Like ``vectorize``, for vocabularies beyond a few dozen words: a function of a column of words. Words are looked up by hash, a
    batch at a time; null lists stay null."""
    if len(vocab) > MAX_VOCABULARY:
        raise ValueError("join the words to a larger vocabulary")
    words, ids = [w for w, _ in vocab], np.array([i for _, i in vocab], np.int32)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def look_up(lists: pa.Array) -> pa.Array:
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(words, pa.string())), -1).to_numpy(zero_copy_only=False)
        found = np.where(at < 0, UNK, ids[at] if len(ids) else UNK)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n + go + eos)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        out[np.arange(len(found)) + np.repeat((go + eos) * np.arange(len(n)) + go, n)] = found
        if go:
            out[ends - n - go - eos] = GO
        if eos:
            out[ends - 1] = EOS
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out), mask=lists.is_null())

    return look_up


def decoder(words: list[str]):
    """Words of ids, their places in a list, joined by blanks; other ids are ``_unk``. A function of a column of ids."""

    @F.arrow_udf(T.StringType())
    def spell(lists: pa.Array) -> pa.Array:
        table = pa.array([*words, "_unk"], pa.string())
        ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        text = table.take(pa.array(np.where((ids < 0) | (ids >= len(words)), len(words), ids)))
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        back = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), text, mask=lists.is_null())
        return pc.binary_join(back, " ")

    return spell


def pad(ids: Column, size: int | Column) -> Column:
    """Zeros on the right up to ``size``; longer lists stay as they are."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(F.lit(0), n - F.size(ids)).cast("int")))


def weights(ids: Column) -> Column:
    """0.0 where the id is padding, else 1.0."""
    return F.transform(ids, lambda i: F.when(i == PAD, 0.0).otherwise(1.0))


def decode(ids: Column, words: Column) -> Column:
    """Words of ids by the map ``words``."""
    return F.transform(ids, lambda i: F.coalesce(F.try_element_at(words, i), F.lit("_unk")))


def between_names(text: Column, a: Column, b: Column) -> Column:
    """[F8] The text after the first name and a blank up to the blank before the second; null if one is missing or they overlap."""
    start = F.call_function("instr", text, a)
    end = F.call_function("instr", text, b)
    length = end - 1 - (start + F.length(a) + 1)
    return F.when((start > 0) & (end > 0) & (length >= 0), F.substring(text, start + F.length(a) + 1, length))


def one_hot(y: Column, n: int) -> Column:
    """``n`` zeros with a one at ``y``; all zeros where y is outside."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == y, 1).otherwise(0))


def clean_lex(c: Column, stop: list[str] = STOPWORDS) -> Column:
    """Words of one letter and stop words left out."""
    return F.array_join(F.filter(F.split(c, " "), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(stop)), " ")


def first_with_prefix(fields: Column, prefix: str) -> Column:
    """The first field that begins with ``prefix``, without it; null if none does."""
    return F.substring(F.get(F.filter(fields, lambda f: f.startswith(prefix)), F.lit(0)), len(prefix) + 1, 1 << 30)


def abbreviation(name: Column) -> Column:
    """Capitals of the words of a name of three or more words; ``#None#`` for shorter names and for three words whose middle one
    has fewer than three characters (a middle initial)."""
    words = F.split(name, r"[-\s]")
    capitals = F.array_join(F.filter(F.transform(words, lambda w: F.substring(w, 1, 1)), lambda c: c.rlike(r"\p{Lu}")), "")
    initial = (F.size(words) == 3) & (F.length(F.get(words, F.lit(1))) < 3)
    return F.when((F.size(words) < 3) | initial, "#None#").otherwise(capitals)


def bracketed(text: Column, arg: Column) -> Column:
    """``arg`` in brackets in the text: as it is, else in upper case, else in lower case; literal."""
    put = lambda a: F.replace(text, a, F.concat(F.lit("["), a, F.lit("]")))
    return F.when(F.contains(text, arg), put(arg)).when(F.contains(text, F.upper(arg)), put(F.upper(arg))).when(F.contains(text, F.lower(arg)), put(F.lower(arg))).otherwise(text)


def word_tags(toks: Column) -> Column:
    """``word/tag/ner`` of each token, blanks between."""
    return F.array_join(F.transform(toks, lambda t: F.concat_ws("/", F.coalesce(t["word"], F.lit("")), F.coalesce(t["tag"], F.lit("")), F.coalesce(t["ner"], F.lit("")))), " ")


def one_line(c: Column) -> Column:
    """[F32] Line breaks become blanks."""
    return F.translate(c, "\n", " ")


def has_prefix(c: Column, prefixes: list[str]) -> Column:
    """[P1] Whether a relation begins with one of the prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def namespace(c: Column) -> Column:
    """The part of a relation up to its first # or $; empty if there is none."""
    return F.regexp_extract(c, r"^([A-Za-z]+[#$])", 1)


def noisy_attribute(c: Column) -> Column:
    """[P10] Attributes of little meaning: whole sentences, anything of saying or being."""
    return c.startswith("sen#") | F.contains(c, F.lit("say")) | F.contains(c, F.lit("-be-")) | c.endswith("-be")


def before_2008(path: Column) -> Column:
    """[P11] Whether a document's path is of the years 2000 to 2007."""
    return path.rlike(r"/200[0-7]/")


def score_label(c: Column) -> tuple[Column, Column]:
    """(score, label) of ``score:label``; the score is null where it's no number, the label may hold colons."""
    label = F.when(F.contains(c, F.lit(":")), F.substring(c, F.call_function("instr", c, F.lit(":")) + 1, F.lit(1 << 30)))
    return F.split(c, ":", 2)[0].try_cast("double"), label


# KB relations and how they read between their arguments.
RELATION_PHRASES = {
    "REL$/people/person/parents": "is a child of",
    "REL$/film/film/written_by": "was written by",
    "REL$/book/written_work/subjects": "is a book on",
    "REL$/location/neighborhood/neighborhood_of": "is a neighborhood of",
    "REL$/business/person/company": "is in",
    "REL$/location/location/containedby": "is inside",
    "REL$/organization/parent/child": "is the parent-company of",
    "REL$/book/book_edition/author_editor": "was edited by",
    "REL$/people/deceased_person/place_of_death": "died in",
    "REL$/sports/sports_team/location": "is based in",
    "REL$/location/country/capital": "'s capital is",
    "REL$/people/person/place_lived": "lived in",
    "REL$/people/person/nationality": "'s nationality is",
    "REL$/book/author/book_editions_published": "published a book on",
    "REL$/people/person/place_of_birth": "was born in",
    "REL$/sports/sports_team/arena_stadium": "'s home stadium is",
    "REL$/film/film/directed_by": "is directed by",
    "REL$/sports/sports_facility/teams": "is the home venue of",
    "REL$/people/person/religion": "'s religion is",
    "REL$/broadcast/broadcast/area_served": "is available in",
    "REL$/book/author/works_written": "wrote",
    "REL$/location/country/administrative_divisions": "contains",
    "REL$/people/person/ethnicity": "'s ethnicity is",
    "REL$/book/book_edition/place_of_publication": "is published in",
    "REL$/business/company/place_founded": "was founded in",
    "REL$/music/artist/label": "is under the label",
    "REL$/location/hud_county_place/county": "is in",
    "REL$/aviation/airport/serves": "serves",
    "REL$/business/company/founders": "'s founders include",
    "REL$/visual_art/visual_artist/artworks": "created",
    "REL$/film/film/produced_by": "was produced by",
    "REL$/music/artist/album": "released",
    "REL$/location/us_county/hud_county_place": "contains",
    "REL$/sports/sports_team_owner/teams_owned": "owns",
    "REL$/media_common/netflix_genre/titles": "is the genre of",
    "REL$/architecture/structure/architect": "'s architect is",
    "REL$/music/artist/origin": "originated in",
    "REL$/film/film/country": "originated in",
    "REL$/music/record_label/artist": "is a label with artist",
    "REL$/business/company/major_shareholders": "'s major shareholders include",
    "REL$/location/us_county/county_seat": "'s government is based in",
    "REL$/architecture/architect/structures_designed": "designed",
    "REL$/military/military_person/participated_in_conflicts": "participated in",
    "REL$/sports/sports_team/league": "is a team of",
    "REL$/transportation/road/major_cities": "goes through",
    "REL$/fictional_universe/fictional_character/character_created_by": "was created by",
    "REL$/music/album/artist": "is an album by",
    "REL$/influence/influence_node/influenced_by": "is influenced by",
    "REL$/fictional_universe/fictional_character_creator/fictional_characters_created": "created",
    "REL$/music/composer/compositions": "composed",
    "REL$/sports/professional_sports_team/owner_s": "is owned by",
}


def relation_phrase(relation: Column, phrases: dict[str, str] = RELATION_PHRASES) -> Column:
    """How a KB relation reads between its arguments, by the table ``phrases``; for any other relation the last part of its path, underscores
    as blanks. Null for null."""
    last = F.translate(F.element_at(F.split(F.regexp_replace(relation, r"^REL\$", ""), "/"), -1), "_", " ")
    known = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, relation), last) if phrases else last


def relation_sentence(a: Column, relation: Column, b: Column) -> Column:
    """The two arguments with the relation's phrase between them; a phrase that begins with 's follows the first one at once."""
    phrase = relation_phrase(relation)
    return F.concat(a, F.when(phrase.startswith("'s"), "").otherwise(" "), phrase, F.lit(" "), b)

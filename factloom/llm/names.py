"""Variant spellings of names typed by people (problem 7).

Method: trie join. Names are folded, abbreviations and nicknames are spelled out, titles left out; names with the same
tokens in any order are one class. The distinct tokens are sharded by length and a pair of three segments, of which one edit
(also a swap of neighbours) leaves two whole. Each shard's tokens form a trie, which the probing tokens traverse as Levenshtein
automata with one edit to spend; that enumerates all neighbours within one edit. Two tokens two edits apart are near through a
token on record that is one edit from both; those of six letters or more also by themselves (they agree with up to two letters
left out), in names whose other tokens agree. Classes that share a rare token or a neighbour of one are then compared over all
orders of their remaining tokens: initials against full names, missing middle initials, missing legal forms, at most two edits in all.

Tokens in more than ``RARE`` classes are shared words (first names, trades, legal forms, much-named persons); they alone don't
make candidates. Every name is also joined on each such word, or on one that a slip made of it, together with a mark of
another token: the word with a letter left out, or its initial against an initial. Words of two or three letters meet by
equality only; names that share nothing but initials are not linked. Records of one class are linked whatever
their number; classes, not copies, are compared.

Cases: null names and names without letters or digits link to nothing; other null columns don't matter; repeated rows link
to each other; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folding import fold_text
from ..session import once, settled, sorted_join, spread, tune

RARE = 50
MIN_TOKEN = 4

# Words that say nothing about who is named, abbreviations, legal forms, short names.
TITLES = set("mr mrs ms miss dr prof professor sen senator rep gov sir rev hon capt gen col lt sgt esq phd md".split())
STOP = set("the of and".split())
FORMS = set("limited incorporated company corporation holdings brothers international association group partners".split())
ABBREVIATIONS = dict(
    ltd="limited", inc="incorporated", co="company", corp="corporation", hldgs="holdings", bros="brothers", intl="international", assn="association", assoc="association",
    univ="university", ft="fort", mt="mount", st="saint", pt="port", no="north", so="south", cnty="county", cty="county", grp="group",
)
PLACES = set("north south east west saint fort mount port".split())
SHORT_NAMES = """
alexander: alex sasha sandy xander|anthony: tony|andrew: andy drew|barbara: barb babs|benjamin: ben benny|catherine: cathy cate|charles: chuck charlie
christopher: chris kit|daniel: dan danny|david: dave davey|deborah: deb debbie|dmitri: mitya dima|donald: don donnie|dorothea: dot dottie dolly thea|dorothy: dot dottie dolly
edward: ned ted eddie ed|elizabeth: liz beth betty eliza libby|emmanuel: manny|eugene: gene|ferdinand: nando ferdie|frances: fran franny|francis: frank|frederick: fred freddie
gerald: gerry jerry|gregory: greg|henrietta: hattie etta hettie|henry: harry hank hal|isadora: izzy dora|james: jim jimmy jamie|jennifer: jen jenny|john: jack johnny
jonathan: jon|jose: pepe|joseph: joe joey|josephine: jo josie|katherine: kate kathy katie kay|kazimir: kaz|kenneth: ken kenny|lawrence: larry|leonard: len lenny leo|lucinda: lucy cindy
margaret: peggy meg maggie marge greta|martha: marty patty|matias: mati|matthew: matt|michael: mike mick mickey|nathaniel: nate nat|nicholas: nick nicky|oliver: ollie|ottokar: otto
patricia: trish pat patty tricia|patrick: pat paddy|peter: pete|philip: phil|philippa: pip pippa|raymond: ray|rebecca: becky|richard: dick rick rich richie|robert: bob rob bobby robbie
ronald: ron ronnie|samuel: sam sammy|sarah: sally sadie|stephanie: steph|stephen: steve|steven: steve|susannah: sue susie suzy|susan: sue susie|theodore: ted teddy theo|thomas: tom tommy
timothy: tim|ulrike: ulli rike|ursula: ulla uschi|valeria: val|victoria: vicky tori|virginia: ginny|walter: walt wally|wendell: wen|william: bill will billy willy liam|xaver: xavi|yolanda: yoli
zachary: zach zack
"""
FORMAL: dict[str, tuple[str, ...]] = {}
for _line in re.split(r"[|\n]", SHORT_NAMES.strip()):
    _full, _, _short = _line.partition(":")
    for _s in _short.split():
        FORMAL[_s] = (*FORMAL.get(_s, ()), _full.strip())

#: Words that many names have and that name nothing by themselves.
GENERIC = FORMS | set("county university city sons".split())
#: Words that are known to be different ones; a slip of the pen is none of them.
KNOWN = PLACES | GENERIC | {n for names in FORMAL.values() for n in names}

_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile(r"['’ʼ`]")


def name_tokens(name: str | None) -> list[str]:
    """Tokens of a name in order: folded, abbreviations and unambiguous short names spelled out, titles and stop words left
    out. Initials behind a first name or behind another initial are middle ones and get a dot before them. A name of nothing but
    titles and stop words keeps them."""
    if not name:
        return []
    words = _WORD.findall(fold_text(_QUOTES.sub("", name)))
    # "co" is a county beside a word of places, or beside the initial of one
    place = any(ABBREVIATIONS.get(w, w) in PLACES or w in ("n", "s", "e", "w") for w in words)
    out = []
    for i, w in enumerate(words):
        if w in TITLES or w in STOP or (w == "city" and words[i + 1 : i + 2] == ["of"]):
            continue
        w = "county" if w == "co" and place else ABBREVIATIONS.get(w, w)
        full = FORMAL.get(w, ())
        out.append(full[0] if len(full) == 1 else w)
    own = sum(len(w) > 1 and w not in PLACES and w not in FORMS and w != "county" for w in out)
    first = own < 2
    for i, w in enumerate(out):
        if len(w) == 1:
            out[i] = w if first else "." + w
            first = False
    return out or words


def is_initial(t: str) -> bool:
    """Whether a token is an initial, of a first name or (with a dot) of a middle one."""
    return len(t) == 1 or t[0] == "."


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int = 2) -> int:
    """Edits between two tokens, a swap of neighbours being one; ``most + 1`` if more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


class Trie:
    """Tokens of one shard; ``near`` runs a token through it as an automaton that has ``left`` edits to spend."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, token: str) -> None:
        node = self.root
        for c in token:
            node = node.setdefault(c, {})
        node[""] = token

    def near(self, s: str, left: int) -> set[str]:
        found: set[str] = set()
        seen: set[tuple[int, int, int]] = set()
        todo = [(self.root, 0, left)]
        while todo:
            node, i, k = todo.pop()
            if (id(node), i, k) in seen:
                continue
            seen.add((id(node), i, k))
            if len(s) - i <= k and "" in node:
                found.add(node[""])
            c = s[i] if i < len(s) else None
            if c is not None and c in node:
                todo.append((node[c], i + 1, k))
            if not k:
                continue
            if c is not None:
                todo.append((node, i + 1, k - 1))  # the token has a letter too many
                d = s[i + 1] if i + 1 < len(s) else None
                if d is not None and c in node.get(d, ()):
                    todo.append((node[d][c], i + 2, k - 1))  # neighbours swapped
            for x, child in node.items():
                if x:
                    todo.append((child, i, k - 1))  # a letter too few
                    if c is not None and x != c:
                        todo.append((child, i + 1, k - 1))  # another letter
        return found


def shard_rows(token: Column) -> Column:
    """Array of (shard, kind, token): where a token is indexed (kind 0), and where it probes (kind 1).

    One edit leaves two of the three segments whole, so a shard is named by a pair of segments: it holds only tokens that differ in the
    third, and no ending or beginning that many tokens share makes a large one. A token probes those of its own length, and those of one
    letter less, whose later segments stand one place further on in it. A swap across the border of two segments is looked for as
    the swapped token.
    """
    n = F.length(token)
    third = lambda m, i: F.floor(m * i / 3).cast("int")

    def row(word: Column, m: Column, kind: int, moves: tuple[int | None, ...]) -> Column:
        parts = [F.substring(word, third(m, i) + 1 + by, third(m, i + 1) - third(m, i)) for i, by in enumerate(moves) if by is not None]
        name = F.lit("".join("-" if by is None else "+" for by in moves))
        return F.struct(F.xxhash64(m, name, *parts).alias("shard"), F.lit(kind).alias("kind"), token.alias("token"))

    own = [(0, 0, None), (0, None, 0), (None, 0, 0)]
    rows = [row(token, n, kind, moves) for moves in own for kind in (0, 1)]
    rows += [row(token, n - 1, 1, moves) for moves in ((0, 0, None), (0, None, 1), (None, 1, 1))]
    for i in (1, 2):
        at = third(n, i)
        swapped = F.concat(F.substring(token, F.lit(1), at - 1), F.substring(token, at + 1, F.lit(1)), F.substring(token, at, F.lit(1)), F.substring(token, at + 2, n))
        rows.append(row(swapped, n, 1, (0, 0, None)))
    return F.array(*rows)


def _near_in_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard and kind -> pairs of tokens within one edit. A shard of one indexed token needs no trie."""
    now, trie, first = None, None, None
    for pdf in batches:
        out = []
        for shard, kind, token in zip(pdf["shard"].to_numpy(), pdf["kind"].to_numpy(), pdf["token"].to_numpy()):
            if shard != now:
                now, trie, first = shard, None, None
            if kind == 0:
                if first is None:
                    first = token
                elif token != first:
                    if trie is None:
                        trie = Trie()
                        trie.add(first)
                    trie.add(token)
            elif trie is not None:
                out += [(token, x) for x in trie.near(token, 1) if x != token]
            elif first is not None and token != first and edits(token, first, 1) == 1:
                out.append((token, first))
        yield pd.DataFrame(out, columns=["t", "u"], dtype=object)


def near_tokens(tokens: DataFrame) -> DataFrame:
    """(t, u): ordered pairs of distinct tokens of the column ``token``, of at least three letters, within one edit of each other."""
    tune(tokens.sparkSession)
    rows = tokens.select(F.inline(shard_rows(F.col("token"))))
    half = rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInPandas(_near_in_shards, "t string, u string")
    return half.select(F.inline(F.array(F.struct("t", "u"), F.struct(F.col("u").alias("t"), F.col("t").alias("u"))))).distinct()


def without(s: str, most: int) -> set[str]:
    """``s`` with up to ``most`` letters left out. Words within ``most`` edits have one of these in common."""
    out = last = {s}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def rests(token: Column) -> Column:
    """Array of the hashes of ``token`` with up to two letters left out, each once."""
    n = F.length(token)
    cut = lambda i, j: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, j - i - 1), F.substring(token, j + 1, n))
    # places from 1; n + 1 stands for no letter, so all pairs i < j up to n + 2 are: two letters, one, none
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(F.sequence(i + 1, n + 2), lambda j: F.xxhash64(cut(i, j)))))
    return F.array_distinct(pairs)


def two_apart(tokens: DataFrame) -> DataFrame:
    """(t, u): ordered pairs of tokens of the column ``token``, of six letters or more, that are two edits apart."""

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[edits(t, u) == 2 for t, u in zip(pdf["t"], pdf["u"])]]

    left = tokens.filter("length(token) >= 6").select(F.explode(rests(F.col("token"))).alias("rest"), F.col("token").alias("t"))
    pairs = left.join(sorted_join(left.withColumnRenamed("t", "u")), "rest").filter("t < u").select("t", "u").distinct()
    half = settled(pairs.mapInPandas(exact, "t string, u string"), "two-apart")
    return half.unionByName(half.select(F.col("u").alias("t"), F.col("t").alias("u")))


#: Full names that share a short name with others, the short names, and these with a letter left out.
_SHORTENED = {x for s, names in FORMAL.items() if len(names) > 1 for n in (s, *names) for x in without(n, 1)}


@F.pandas_udf(T.BooleanType())
def _has_short(tokens: pd.Series) -> pd.Series:
    """Whether a token is, within one edit, one that an ambiguous short name may stand for."""
    return tokens.map(lambda t: not _SHORTENED.isdisjoint(without(t, 1))).astype(bool)


def marks(tokens: list[str], t: str, lone: str | None, looking: bool) -> set[str]:
    """What the tokens beside ``t`` must have in common with those of a name that is to be compared: words within one edit and
    short names share a mark, so do an initial and a word, of which one name is ``looking`` and the other is not. ``lone`` is a
    word whose other spellings are found without marks, so that only itself and its initial are marks."""
    rest = list(tokens)
    rest.remove(t)
    if not rest:
        return {"!"}
    if lone is not None:
        rest = [lone]
    else:
        rest = [o for o in rest if o[0] != "." and o not in FORMS] or rest
    word, initial = ("i", "w") if looking else ("w", "i")
    out = set()
    for o in rest:
        full = FORMAL.get(o, ())
        if len(o) == 1:
            out.add(initial + o)
        elif o[0] != "." and o not in FORMS:
            out |= {word + w[0] for w in (o, *full)}
        if o != lone:
            out |= {"=" + x for w in (o, *full) for x in (without(w, 1) if len(w) >= MIN_TOKEN else (w,))}
        else:
            out.add("=" + o)  # of names that are two edits apart in ``t``
    return out


def _marked_keys(rows: DataFrame, looking: bool) -> DataFrame:
    """Rows (cls, t, u, lone) with ``key``, one for each mark beside ``t``."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(c, t, u, m) for c, t, u, one in zip(pdf["cls"], pdf["t"], pdf["u"], pdf["lone"]) for m in marks(c.split(" "), t, one, looking)]
            yield pd.DataFrame(out, columns=["cls", "t", "u", "mark"], dtype=object)

    return rows.mapInPandas(spread, "cls string, t string, u string, mark string").select(F.xxhash64("u", "mark").alias("key"), "cls", "t", "u")


@lru_cache(maxsize=100_000)
def _word_cost(a: str, b: str) -> int:
    """Cost of taking one token for the other, 3 if it can't be."""
    if a == b:
        return 0
    if a in KNOWN and b in KNOWN:
        return 3
    fa, fb = FORMAL.get(a, ()), FORMAL.get(b, ())
    if set(fa or (a,)) & set(fb or (b,)):
        return 0
    if is_initial(a) or is_initial(b):
        if is_initial(a) and is_initial(b) or "." in (a[0], b[0]):
            return 3
        initial, word = (a, b) if len(a) == 1 else (b, a)
        return 0 if word not in FORMS and any(w[0] == initial for w in (word, *FORMAL.get(word, ()))) else 3
    best = 3
    for x in fa or (a,):
        for y in fb or (b,):
            short = min(len(x), len(y))
            if short >= MIN_TOKEN and (d := edits(x, y)) <= (1 if short < 6 else 2):
                best = min(best, d)
    return best


def same_name(xs: list[str], ys: list[str], spent: int, most: int = 2, shared: str | None = None) -> bool:
    """Whether the tokens beside the shared one agree in some order, within ``most`` edits in all. If the ``shared`` one is a word of many
    names (a county, a legal form), another word must agree with a word, not only with an initial."""
    if not xs and not ys:
        return True
    if not xs or not ys:
        return False
    xs, ys = sorted(xs, key=lambda t: (-len(t), t)), list(ys)
    # an initial that both names have stands for itself, not for a word of the other name
    alike = 0
    for x in [x for x in xs if is_initial(x)]:
        if x in ys:
            xs.remove(x)
            ys.remove(x)
            alike += 1

    def rest_ok(left_x: list[str], left_y: list[str]) -> bool:
        for mine, other in ((left_x, left_y), (left_y, left_x)):
            if any(t[0] != "." and t not in FORMS for t in mine):
                return False
            if any(t in FORMS for t in mine) and any(t in FORMS for t in other):
                return False
            if any(is_initial(t) for t in mine) and any(is_initial(t) for t in other):
                return False
        return True

    def go(i: int, free: list[str], left: list[str], cost: int, met: int, strong: bool) -> bool:
        if i == len(xs):
            return met > 0 and strong and rest_ok(left, free)
        x = xs[i]
        order = sorted(((_word_cost(x, y), y) for y in set(free)), key=lambda p: p[0])
        for c, y in order:
            if cost + c > most:
                break
            k = free.index(y)
            if go(i + 1, free[:k] + free[k + 1 :], left, cost + c, met + 1, strong or not (is_initial(x) or is_initial(y) or x in GENERIC)):
                return True
            if c == 0 and not is_initial(x) and x == y:
                return False  # an equal word needs no other partner
        return (x[0] == "." or x in FORMS) and go(i + 1, free, [*left, x], cost, met, strong)

    return go(0, ys, [], spent, alike, shared not in GENERIC)


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for x, y, t, u in zip(pdf["x"], pdf["y"], pdf["t"], pdf["u"]):
            xs, ys = x.split(" "), y.split(" ")
            xs.remove(t)
            ys.remove(u)
            keep.append((t == u or t not in KNOWN or u not in KNOWN) and same_name(xs, ys, edits(t, u), shared=t))
        yield pdf.loc[keep, ["x", "y"]]


def name_classes(names: DataFrame) -> DataFrame:
    """``names`` with a column ``name``: adds ``cls``, its sorted tokens; names without tokens are left out."""

    @F.pandas_udf(T.StringType())
    def cls(s: pd.Series) -> pd.Series:
        return s.map(lambda n: " ".join(sorted(name_tokens(n))))

    tune(names.sparkSession)
    return once(names.filter(F.col("name").isNotNull()), *[c for c in names.columns if c not in ("name", "cls")], cls=cls("name")).filter("cls <> ''")


def candidate_pairs(classes: DataFrame, rare: int = RARE) -> DataFrame:
    """(x, y, t, u), x < y: classes of the column ``cls`` that are to be compared, with the tokens by which they met."""
    all_tokens = F.array_distinct(F.split("cls", " "))
    flat = settled(classes.select("cls", F.explode(all_tokens).alias("token")).filter("length(token) > 1 and not startswith(token, '.')"), "tokens")
    df = settled(flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "vocabulary")
    one = settled(near_tokens(spread(df).filter(F.length("token") >= MIN_TOKEN)), "near")
    # two steps through a token on record; a token is near itself
    two = one.select("t", F.col("u").alias("m")).join(sorted_join(one.select(F.col("t").alias("m"), "u")), "m").filter("t <> u").select("t", "u")
    far = two_apart(spread(df)).withColumn("step", F.lit(False))
    near = one.unionByName(two).unionByName(df.select(F.col("token").alias("t"), F.col("token").alias("u"))).withColumn("step", F.lit(True))
    near = near.unionByName(far).groupBy("t", "u").agg(F.max("step").alias("step"))
    freq = df.select(F.col("token").alias("u"), (F.col("df") <= rare).alias("u_rare"))
    near = settled(near.join(sorted_join(freq), "u"), "neighbours")

    # a rare token without a common neighbour meets any other spelling of it by itself, so only its initial is left to look for
    flags = near.groupBy("t").agg(F.max(~F.col("u_rare")).alias("by_common"), F.max(F.when(F.col("t") == F.col("u"), F.col("u_rare"))).alias("t_rare"))
    marked = flat.withColumnRenamed("token", "t").join(sorted_join(flags), "t")
    lone = F.max(F.when(~F.col("by_common") & ~F.col("t").isin(*sorted(FORMS)) & ~_has_short("t"), F.col("t"))).alias("lone")
    marked = settled(marked.join(sorted_join(marked.groupBy("cls").agg(lone)), "cls"), "marked")
    # one side gives its own tokens, the other the neighbours of its tokens; a common token goes with a mark of another token
    own = marked.filter("t_rare").select(F.xxhash64("t").alias("key"), F.col("cls").alias("y"), F.col("t").alias("u"))
    own = own.unionByName(_marked_keys(marked.filter("not t_rare").select("cls", "t", F.col("t").alias("u"), "lone"), False).select("key", F.col("cls").alias("y"), "u"))
    near = near.join(sorted_join(flags.select("t", "t_rare")), "t")
    reach = marked.select("cls", "t", "lone").join(sorted_join(near.filter("t_rare or not u_rare")), "t")
    # two edits without a step need another token that agrees
    reach = reach.filter("step or contains(cls, ' ')")
    reach, common = reach.filter("u_rare"), reach.filter("not u_rare")
    reach = reach.select(F.xxhash64("u").alias("key"), F.col("cls").alias("x"), "t")
    reach = reach.unionByName(_marked_keys(common.select("cls", "t", "u", "lone"), True).select("key", F.col("cls").alias("x"), "t"))
    pairs = reach.join(sorted_join(own), "key").filter("x <> y")
    swap = F.col("x") > F.col("y")
    pairs = pairs.select(*[F.when(swap, b).otherwise(F.col(a)).alias(a) for a, b in (("x", F.col("y")), ("y", F.col("x")), ("t", F.col("u")), ("u", F.col("t")))])
    return pairs.distinct()


def linked_classes(classes: DataFrame, rare: int = RARE) -> DataFrame:
    """(x, y), x < y: classes of the column ``cls`` that name the same entity."""
    return candidate_pairs(classes, rare).mapInPandas(_verified, "x string, y string").distinct()


def same_entity_pairs(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(key_a, key_b), smaller first: two records of ``entities`` (ent_key, ent_name), or one of them and one of the
    ``mentions`` (mention_key, label, entity) with a null entity, that name the same entity. Linked mentions only lend their
    spellings as steps between tokens."""
    kb = entities.select(F.col("ent_key").alias("key"), F.col("ent_name").alias("name"), F.lit(0).alias("side"))
    said = mentions.select(F.col("mention_key").alias("key"), F.col("label").alias("name"), F.when(F.col("entity").isNull(), 1).otherwise(2).alias("side"))
    rows = settled(name_classes(kb.unionByName(said)), "names")
    links = linked_classes(rows.select("cls").distinct())
    wanted = rows.filter("side < 2")
    links = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    links = links.unionByName(wanted.filter("side = 0").select(F.col("cls").alias("x"), F.col("cls").alias("y")).distinct())
    a = wanted.filter("side = 0").select(F.col("cls").alias("x"), F.col("key").alias("ka"))
    b = wanted.select(F.col("cls").alias("y"), F.col("key").alias("kb"), "side")
    pairs = links.join(sorted_join(a), "x").join(sorted_join(b), "y").filter("side = 1 or ka < kb")
    return pairs.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))

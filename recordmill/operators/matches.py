"""Match results: sets, winners and tours, odds as they opened and closed, seasons of players, and the listing that a run emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.listings import round_code
from ..functions.page_items import Items, Pick, page_items
from ..functions.text import squash
from ..storage import Steps
from ..types import col, number
from .ordered import first_wins, placed

#: Names of competitions outside the tours, and of surfaces.
OTHER_EVENTS = ("utr", "exhibition", "asian games", "olympic", "davis cup", "billie jean", "united cup", "laver cup", "hopman", "world tennis league", "six kings", "next gen", "university", "youth")
SURFACES = ("clay", "hard", "grass", "carpet", "indoors")
SET = "struct<a:int,b:int,tiebreak:int>"

#: A match's own page: what is said above it, its players with their ranks, and the table of bookmakers.
DETAIL = Items(
    "#center",
    {
        "said": Pick(".boxBasic"),
        "players": Items("table.gDetail thead th.plName", {"name": Pick(), "href": Pick("a", attr="href")}),
        "facts": Items("table.gDetail tbody tr", {"name": Pick("th"), "first": Pick("td.tr"), "second": Pick("td.tl")}),
        "odds": Items(
            "#oddsMenu-1-data table.result tr",
            {
                "class": Pick(attr="class"),
                "name": Pick("td.first .t"),
                "cell": Pick("td.first"),
                "home": Pick("td.k1 .odds-in", own=True),
                "away": Pick("td.k2 .odds-in", own=True),
                "home_moves": Pick("td.k1 .odds-in .odds-change-div tr td.bold", which="all"),
                "away_moves": Pick("td.k2 .odds-in .odds-change-div tr td.bold", which="all"),
            },
            outside=".odds-change-div",
        ),
    },
)
#: A player's page: rows of all seasons under heads that name the tournament.
SEASONS = Items(
    "#center",
    {
        "name": Pick("table.plDetail h3"),
        "facts": Pick("table.plDetail .date", which="all"),
        "seasons": Items(
            ".matches",
            {
                "id": Pick(attr="id"),
                "rows": Items(
                    "table.result tr",
                    {"class": Pick(attr="class"), "head": Pick("td.t-name"), "day": Pick("td.time"), "names": Pick("td.t-name a", which="all"), "slugs": Pick("td.t-name a", attr="href", which="all"), "score": Pick("td.tl a", mark="sup"), "link": Pick("td.tl a", attr="href"), "surface": Pick("td.s-color span", attr="title"), "round": Pick("td.round"), "odds": Pick("td.course", which="all")},
                ),
            },
        ),
    },
)


def markup_sets(html) -> Column:
    """Sets of `6<sup>8</sup>-7, 6-3`: array of struct(a, b, tiebreak); what is no set is left out."""
    return marked_sets(F.regexp_replace(F.regexp_replace(col(html), r"<sup>\s*([0-9]+)\s*</sup>", "^$1"), "<[^>]*>", ""))


def marked_sets(text) -> Column:
    """As markup_sets, the tie-break marked with ^."""
    form = r"^\s*([0-9]+)(?:\^([0-9]+))?\s*-\s*([0-9]+)(?:\^([0-9]+))?\s*$"
    sets = F.filter(F.split(F.coalesce(col(text), F.lit("")), ","), lambda s: s.rlike(form))
    parts = F.transform(sets, lambda s: F.split(F.regexp_replace(s, form, "$1,$2,$3,$4"), ","))
    # a cast that fails costs far more than one that works, so none is tried on a tie-break that is not there
    part = lambda p, i: F.when(p[i] != "", p[i].try_cast("int"))
    return F.transform(parts, lambda p: F.struct(p[0].try_cast("int").alias("a"), p[2].try_cast("int").alias("b"), F.coalesce(part(p, 1), part(p, 3)).alias("tiebreak")))


def set_over(a: Column, b: Column) -> Column:
    """Seven to six, or six and more with two ahead."""
    high, low = F.greatest(a, b), F.least(a, b)
    return ((high == 7) & (low == 6)) | ((high >= 6) & (high - low >= 2))


def summary(sets: Column, won_a: Column | None = None, won_b: Column | None = None) -> Column:
    """struct(winner: 1, 2 or null; status; score) of sets and, where a page has them, the sets that each side won.

    Without sets it was a walkover; a last set that is not over means that somebody retired.
    """
    count = lambda given, f: F.coalesce(*([given] if given is not None else []), F.size(F.filter(sets, f)))
    a, b = count(won_a, lambda s: s["a"] > s["b"]), count(won_b, lambda s: s["b"] > s["a"])
    last = F.element_at(sets, -1)
    status = F.when(F.size(sets) < 1, "walkover").when(~set_over(last["a"], last["b"]), "retired").otherwise("completed")
    text = lambda s: F.concat(s["a"].cast("string"), F.lit("-"), s["b"].cast("string"), F.coalesce(F.concat(F.lit("("), s["tiebreak"].cast("string"), F.lit(")")), F.lit("")))
    return F.struct(F.when(a > b, 1).when(b > a, 2).alias("winner"), F.when(F.size(sets) < 1, "walkover").otherwise(status).alias("status"), F.array_join(F.transform(sets, text), " ").alias("score"))


def tour_of(name, women, url=None) -> Column:
    """CHALLENGER, ITF_MEN, ITF_WOMEN, OTHER_MEN, OTHER_WOMEN, ATP or WTA by the name and address of a tournament."""
    own = F.lower(F.coalesce(col(name), F.lit("")))
    both = own if url is None else F.concat_ws(" ", own, F.lower(col(url)))
    side = lambda prefix: F.when(col(women), f"{prefix}_WOMEN").otherwise(f"{prefix}_MEN")
    other = own.rlike(r"\b(?:" + "|".join(OTHER_EVENTS) + r")\b")
    return F.when(F.contains(both, F.lit("challenger")), "CHALLENGER").when(both.rlike(r"\bitf\b|futures"), side("ITF")).when(other, side("OTHER")).otherwise(F.when(col(women), "WTA").otherwise("ATP"))


def surface_of(text) -> Column:
    t = F.lower(F.trim(col(text)))
    return F.when(t.isin(*SURFACES), t)


def player_slug(href) -> Column:
    return F.nullif(F.regexp_extract(col(href), r"/player/([^/?#]+)", 1), F.lit(""))


def read_details(pages: DataFrame, html: str = "html") -> DataFrame:
    """Details of matches: date, time, surface, round, players (slug, name, rank) and odds (bookmaker, home, away, opened_home, opened_away); a page of another layout has `broken` set and the rest null.

    The head of a page says day, time, place and, last, rounds and the surface.  The history under an odd has the newest first, so its last one is where it opened.  Sums of bookmakers are no bookmakers.
    """
    d, parts, ranking = F.col("__d"), F.col("__parts"), F.col("__ranking")
    day = F.regexp_extract(F.get(parts, F.lit(0)), r"^([0-9]{2}\.[0-9]{2}\.[0-9]{4})$", 1)
    rest = F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0)))
    last = F.when(F.size(rest) > 0, F.element_at(rest, -1))
    surface = surface_of(last)
    rounds = F.array_join(F.when(surface.isNotNull(), F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest), ", ")
    rank = lambda i: F.regexp_extract(F.when(i == 0, ranking["first"]).otherwise(ranking["second"]), r"^([0-9]+)\.?$", 1).try_cast("int")
    players = F.transform(d["players"], lambda p, i: F.struct(player_slug(p["href"]).alias("slug"), squash(p["name"]).alias("name"), rank(i).alias("rank")))
    opened = lambda moves: number(F.when(F.size(moves) > 0, F.element_at(moves, -1)))
    name = lambda o: F.coalesce(squash(o["name"]), squash(o["cell"]))
    single = F.filter(d["odds"], lambda o: ~F.coalesce(o["class"], F.lit("")).rlike(r"\b(head|average|highest)\b"))
    told = F.transform(single, lambda o: F.struct(name(o).alias("bookmaker"), number(o["home"]).alias("home"), number(o["away"]).alias("away"), opened(o["home_moves"]).alias("opened_home"), opened(o["away_moves"]).alias("opened_away")))
    odds = F.filter(told, lambda o: o["bookmaker"].isNotNull() & ~F.lower(o["bookmaker"]).rlike("^(average|highest)") & (o["home"].isNotNull() | o["away"].isNotNull()))
    read = pages.withColumn("__d", F.get(page_items(F.col(html), DETAIL), F.lit(0))).drop(html)
    read = read.withColumns({"__parts": F.transform(F.split(F.col("__d.said"), r",\s+"), lambda x: F.trim(x)), "__ranking": F.get(F.filter("__d.facts", lambda f: F.lower(f["name"]).rlike("singles ranking")), F.lit(0))})
    return read.withColumns(
        {
            "broken": F.size(F.coalesce(d["players"], F.array())) == 0,
            "date": F.try_to_date(F.nullif(day, F.lit("")), "dd.MM.yyyy"),
            "time": F.nullif(F.regexp_extract(F.get(parts, F.lit(1)), r"^([0-9]{1,2}:[0-9]{2})$", 1), F.lit("")),
            "surface": surface,
            "round": round_code(rounds),
            "players": players,
            "odds": odds,
        }
    ).drop("__d", "__parts", "__ranking")


def with_details(matches: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """matches (key, slug_a, slug_b, name_a, name_b, winner) with what their pages add: round, surface, time, full names, ranks, the winner's name and odds.

    A page that lists the players the other way round is turned: names, ranks and both kinds of odds.  What the listing has stays.
    """
    d = first_wins(details.where("not broken"), [key], [F.size("odds").desc(), F.to_json("players")]).select(key, F.struct("date", "time", "surface", "round", "players", "odds").alias("d"))
    joined = matches.join(d, key, "left")
    first, second = F.get("d.players", F.lit(0)), F.get("d.players", F.lit(1))
    turned = F.coalesce((first["slug"] == F.col("slug_b")) & (second["slug"] == F.col("slug_a")), F.lit(False))
    side = lambda x, y, f: F.when(turned, y[f]).otherwise(x[f])
    have = lambda c: F.col(c) if c in matches.columns else F.lit(None).cast("string")
    swap = lambda o: F.struct(o["bookmaker"].alias("bookmaker"), o["away"].alias("home"), o["home"].alias("away"), o["opened_away"].alias("opened_home"), o["opened_home"].alias("opened_away"))
    kind = "array<struct<bookmaker:string,home:double,away:double,opened_home:double,opened_away:double>>"
    out = joined.withColumns({
        "round": F.coalesce(have("round"), F.col("d.round")), "surface": F.coalesce(have("surface"), F.col("d.surface")), "time": F.coalesce(have("time"), F.col("d.time")),
        "name_a": F.coalesce(side(first, second, "name"), F.col("name_a")), "name_b": F.coalesce(side(second, first, "name"), F.col("name_b")),
        "rank_a": side(first, second, "rank"), "rank_b": side(second, first, "rank"),
        "odds": F.coalesce(F.when(turned, F.transform("d.odds", swap)).otherwise(F.col("d.odds")), F.array().cast(kind)),
    })
    return out.withColumn("winner_name", F.when(F.col("winner") == 1, F.col("name_a")).when(F.col("winner") == 2, F.col("name_b"))).drop("d")


def read_seasons(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Matches of players' pages, a row each (key, year, at: its place): match_id, date, tournament (of the head above), tour, name_a, name_b, slug_a, slug_b, surface, round, sets, winner, status, score, odds_a, odds_b.

    The winner stands first in these lists, so a match with sets or a walkover is the first one's.  Seasons are elements of class
    `matches` with the year in their id.  Rows without a match or a day are left out, and a match that a season repeats counts once.
    """
    read = pages.withColumn("__p", page_items(F.col(html), SEASONS)).select(key, F.explode("__p").alias("__p"))
    women = F.exists("__p.facts", lambda t: F.lower(t).rlike("^sex:.*woman"))
    s = read.select(key, women.alias("__women"), F.explode("__p.seasons").alias("__s")).withColumn("__rows", F.col("__s.rows"))
    is_head = lambda r: F.coalesce(r["class"], F.lit("")).rlike(r"\bhead\b")
    heads = F.filter(F.transform("__rows", lambda r, i: F.named_struct(F.lit("at"), i, F.lit("is"), is_head(r), F.lit("text"), r["head"])), lambda h: h["is"])
    s = s.select(key, "__women", F.regexp_extract("__s.id", "([0-9]{4})", 1).try_cast("int").alias("year"), heads.alias("__heads"), F.posexplode("__rows").alias("at", "__r"))
    x = F.col("__r")
    above = F.filter("__heads", lambda h: h["at"] < F.col("at"))
    day = F.nullif(F.regexp_extract(x["day"], r"^([0-9]{2}\.[0-9]{2}\.)$", 1), F.lit(""))
    said = F.lower(F.coalesce(x["score"], F.lit("")))
    out = s.select(
        key, "year", "at", F.nullif(F.regexp_extract(x["link"], r"match-detail/\?id=([0-9]+)", 1), F.lit("")).alias("match_id"), F.try_to_date(F.concat(day, F.col("year").cast("string")), "dd.MM.yyyy").alias("date"),
        squash(F.try_element_at(above, F.lit(-1))["text"]).alias("tournament"), "__women", *[squash(F.get(x["names"], F.lit(i))).alias(f"name_{c}") for i, c in enumerate("ab")], *[player_slug(F.get(x["slugs"], F.lit(i))).alias(f"slug_{c}") for i, c in enumerate("ab")],
        surface_of(x["surface"]).alias("surface"), round_code(x["round"]).alias("round"), marked_sets(F.regexp_replace(x["score"], r"(?i)[,\s]*\bret\.?.*", "")).alias("sets"), said.rlike(r"w/?o\b|walkover").alias("__walked"), said.rlike(r"\bret").alias("__retired"),
        *[number(F.get(x["odds"], F.lit(i))).alias(f"odds_{c}") for i, c in enumerate("ab")],
    ).where("match_id is not null and date is not null")
    told = summary(F.col("sets"))
    out = first_wins(out, [key, "year", "match_id"], ["at"]).withColumn("__told", told)
    winner = F.when((F.size("sets") > 0) | F.col("__walked"), F.lit(1)).otherwise(F.col("__told.winner"))
    out = out.withColumns({"tour": tour_of("tournament", F.col("__women")), "winner": winner, "status": F.when(F.col("__retired"), "retired").otherwise(F.col("__told.status")), "score": F.col("__told.score")})
    return out.drop("__women", "__walked", "__retired", "__told")


def emitted_matches(listed: DataFrame, tours: list[str], seen: DataFrame, key: str, day: str, order: list, most: int) -> DataFrame:
    """The listing of a run: matches of the tours wanted, each once (where it was listed first, latest day first), that no run before emitted, up to `most`, with their place.

    Places are counted by day and then moved on, so that no task holds more than a day.  The rows are written as a table first, as
    both sizes of days and places are taken from them and pages should be taken apart once; it stays for the rows that are read from it.
    """
    wanted = first_wins(listed.where(F.col("tour").isin(tours)), [key], [F.col(day).desc_nulls_last(), *order])
    fresh = wanted.join(seen.select(F.col(key).alias("__seen")).distinct(), F.col(key).eqNullSafe(F.col("__seen")), "left_anti")
    fresh = Steps(listed.sparkSession, "matches").put(fresh)
    return placed(fresh, [], [(F.col(day), True)], order, "place").where(F.col("place") <= most)

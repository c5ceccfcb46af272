"""Posts of public channels out of their preview pages, and the feed of a run over them: searches by keyword, streaks that end them, rows of information and of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import compact
from ..functions.page_items import Items, Pick, page_items
from ..functions.text import squash
from ..storage import Steps
from ..types import col, join_keys
from .ordered import first_wins

#: Class names of the preview pages, and what their kinds of media are called.
_M = ".tgme_widget_message_"
QUOTED = f"{_M}reply, {_M}link_preview"
MEDIA = {"photo_wrap": "photo", "video_player": "video", "roundvideo_player": "roundVideo", "voice_player": "voice", "document_wrap": "document", "sticker_wrap": "sticker", "poll": "poll", "location_wrap": "location"}
PAGE = Items(
    "",
    {
        "history": Pick(".tgme_channel_history, .tgme_widget_message_wrap", attr="class"),
        "title": Pick(".tgme_page_title"),
        "extra": Pick(".tgme_page_extra", which="all"),
        "name": Pick(".tgme_channel_info .tgme_channel_info_header_title"),
        "about": Pick(".tgme_channel_info .tgme_channel_info_description"),
        "counters": Items(".tgme_channel_info .tgme_channel_info_counter", {"type": Pick(".counter_type"), "value": Pick(".counter_value")}),
        "posts": Items(
            ".tgme_widget_message[data-post]",
            {
                "post": Pick(attr="data-post"),
                "class": Pick(attr="class"),
                "at": Pick(f"{_M}date time", attr="datetime", which="last"),
                "meta": Pick(f"{_M}meta"),
                "author": Pick(f"{_M}meta {_M}from_author"),
                "text": Pick(f"{_M}text", outside=QUOTED),
                "links": Pick(f"{_M}text a[href]", attr="href", which="all", outside=QUOTED),
                "preview": Pick(f"a{_M}link_preview", attr="href"),
                "views": Pick(f"{_M}views"),
                "forwarded": Pick(f"{_M}forwarded_from_name", attr="href"),
                "reply": Pick(f"a{_M}reply", attr="href"),
                "reactions": Items(f"{_M}reactions .tgme_reaction", {"count": Pick(own=True), "emoji": Pick("b"), "custom": Pick("tg-emoji", attr="emoji-id"), "class": Pick(attr="class")}),
                "media": Items(
                    ", ".join(f"{_M}{kind}" for kind in MEDIA),
                    {
                        "class": Pick(attr="class"),
                        "style": Pick(attr="style"),
                        "href": Pick(attr="href"),
                        "src": Pick("video, audio", attr="src"),
                        "sticker": Pick(f"{_M}sticker", attr="data-webp"),
                        "icon": Pick(f"{_M}document_icon", attr="class"),
                        "duration": Pick(f".message_video_duration, {_M}voice_duration, {_M}roundvideo_duration"),
                        "title": Pick(f"{_M}document_title, {_M}poll_question"),
                        "detail": Pick(f"{_M}document_extra"),
                    },
                    outside=QUOTED,
                ),
            },
        ),
    },
)
#: Why a channel gives no posts, by the kind of its page.
ERRORS = {"notFound": "notFound", "channel": "previewDisabled", "group": "notAChannel", "user": "notAChannel"}


def whole_url(url) -> Column:
    """'//host/path' with its scheme."""
    return F.when(F.startswith(col(url), F.lit("//")), F.concat(F.lit("https:"), col(url))).otherwise(col(url))


def background(style) -> Column:
    """The address of a background image in a style."""
    return whole_url(F.nullif(F.regexp_extract(col(style), r"background-image:\s*url\(['\"]?([^'\")]+)", 1), F.lit("")))


def post_ref(url) -> Column:
    """struct(channel, post_id) of a link to a channel or a post; private links have neither."""
    pattern = r"^https?://t\.me/(?:s/)?([A-Za-z0-9_]+)(?:/(\d+))?"
    name = F.lower(F.regexp_extract(col(url), pattern, 1))
    open_ = (name != "") & (name != "c")
    return F.struct(F.when(open_, name).alias("channel"), F.when(open_, F.regexp_extract(col(url), pattern, 2).try_cast("long")).alias("post_id"))


def page_kind(page: Column) -> Column:
    """preview, channel (without a preview), group, user or notFound."""
    extra = F.lower(F.array_join(page["extra"], " "))
    kind = F.when(page["history"].isNotNull(), "preview").when(page["title"].isNull(), "notFound")
    return kind.when(extra.rlike(r"\bsubscribers?\b"), "channel").when(extra.rlike(r"\bmembers?\b"), "group").otherwise("user")


def _media(m: Column) -> Column:
    classes = F.split(m["class"], r"\s+")
    kind = F.lit(None).cast("string")
    for name, label in reversed(MEDIA.items()):
        kind = F.when(F.array_contains(classes, f"tgme_widget_message_{name}"), label).otherwise(kind)
    kind = F.when((kind == "document") & m["icon"].rlike(r"\baudio\b"), "audio").otherwise(kind)
    return F.struct(
        kind.alias("type"),
        F.when(kind == "photo", background(m["style"])).when(kind == "sticker", F.coalesce(whole_url(m["sticker"]), whole_url(m["src"]))).otherwise(whole_url(F.coalesce(m["src"], m["href"]))).alias("url"),
        squash(m["duration"]).alias("duration"),
        F.nullif(F.concat_ws(" - ", squash(m["title"]), squash(m["detail"])), F.lit("")).alias("title"),
    )


def read_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without their html, with `page` (PAGE), `kind` and subscribers: rounded on previews, exact on landing pages."""
    read = pages.withColumn("page", page_items(F.col(html), PAGE)[0]).drop(html)
    counter = F.filter(F.col("page.counters"), lambda c: F.lower(c["type"]).isin("subscribers", "subscriber", "members"))
    said = F.regexp_extract(F.array_join(F.col("page.extra"), "\n"), r"(?i)([0-9][0-9 ,.]*[KMB]?)\s*subscribers?", 1)
    return read.withColumns({"kind": page_kind(F.col("page")), "subscribers": F.coalesce(compact(F.get(counter, F.lit(0))["value"]), compact(said))})


def posts_of(read: DataFrame) -> DataFrame:
    """Posts of read_pages' rows in page order (`place`): post_id, at, edited, author, text, views, reactions, media, links, hashtags, forwarded_from, reply_to; service messages and posts without a time are left out."""
    keep = [c for c in read.columns if c not in ("page", "kind", "subscribers")]
    p = read.select(*keep, F.posexplode("page.posts").alias("place", "p"))
    x = F.col("p")
    links = F.array_distinct(F.array_compact(F.concat(F.filter(x["links"], lambda u: u.rlike("^(?i)https?://")), F.array(x["preview"]))))
    tags = F.array_distinct(F.regexp_extract_all(F.coalesce(x["text"], F.lit("")), F.lit(r"(?<![\p{L}\p{N}_&])#([\p{L}\p{N}_]+)"), 1))
    reaction = lambda r: F.struct(r["emoji"].alias("emoji"), F.when(r["emoji"].isNull(), r["custom"]).alias("custom"), F.coalesce(r["class"].rlike(r"\btgme_reaction_paid\b"), F.lit(False)).alias("paid"), compact(r["count"]).alias("count"))
    out = p.select(
        *keep, "place", post_ref(F.concat(F.lit("https://t.me/"), x["post"]))["post_id"].alias("post_id"), F.try_to_timestamp(x["at"]).alias("at"),
        F.coalesce(x["meta"].rlike(r"(?i)\bedited\b"), F.lit(False)).alias("edited"), squash(x["author"]).alias("author"), F.coalesce(x["text"], F.lit("")).alias("text"), compact(x["views"]).alias("views"),
        F.transform(x["reactions"], reaction).alias("reactions"), F.transform(x["media"], _media).alias("media"), links.alias("links"), tags.alias("hashtags"), post_ref(x["forwarded"]).alias("forwarded_from"), post_ref(x["reply"]).alias("reply_to"),
        x["class"].rlike(r"\bservice_message\b").alias("__service"),
    )
    return out.where("not __service and post_id is not null and at is not null").drop("__service")


def search_posts(posts: DataFrame, returned: DataFrame | None, seen: DataFrame, since: Column | None, most: int, streak: int = 3) -> DataFrame:
    """One search of each channel (channel, page_no, post_id, at): its rows up to where it ends, with `fresh` (to be emitted) and `ended`.

    It goes page by page and on a page from the highest post down; a post counts once, and not at all if an earlier search
    returned it.  It ends with `streak` posts in a row that are older than `since` (reachedSinceDate), with as many known ones
    in a row, old ones passed over (reachedSeen), or with the most-th fresh one (maxPosts).  Windows stream over a channel.
    """
    order = ["page_no", F.col("post_id").desc()]
    rows = first_wins(posts, ["channel", "post_id"], ["page_no", "place"])
    if returned is not None:
        rows = join_keys(rows, returned.select("channel", "post_id").distinct(), ["channel", "post_id"], "left_anti")
    rows = join_keys(rows, seen.select("channel", "post_id", F.lit(True).alias("__known")).distinct(), ["channel", "post_id"], "left")
    old = F.lit(False) if since is None else F.coalesce(F.col("at") < since, F.lit(False))
    rows = rows.withColumn("__old", old).withColumn("__known", ~F.col("__old") & F.coalesce("__known", F.lit(False))).withColumn("fresh", ~F.col("__old") & ~F.col("__known"))
    w = Window.partitionBy("channel").orderBy(*order)
    up_to, count = w.rowsBetween(Window.unboundedPreceding, 0), lambda c: F.sum(F.col(c).cast("int"))
    rows = rows.withColumns({"__young": F.sum((~F.col("__old")).cast("int")).over(up_to), "__found": count("fresh").over(up_to)})
    # `__found` numbers the stretches between fresh posts, `__young` those between posts that are not old
    olds, knowns = ((Window.partitionBy("channel", n).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) for n in ("__young", "__found"))
    rows = rows.withColumns({"__olds": count("__old").over(olds), "__knowns": count("__known").over(knowns)})
    ended = F.when(F.col("__olds") >= streak, "reachedSinceDate").when(F.col("__knowns") >= streak, "reachedSeen").when(F.col("fresh") & (F.col("__found") >= most), "maxPosts")
    rows = rows.withColumn("ended", ended)
    before = F.count("ended").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__before", before).where("__before = 0").drop(*[c for c in ("__old", "__known", "__young", "__found", "__olds", "__knowns", "__before")])


def channel_feed(channels: DataFrame, pages: DataFrame, keywords: list[str], seen: DataFrame, since: Column | None, most: int, streak: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, statuses, seen posts of the next run) of a run over `channels` (channel; `input`, what was asked for).

    pages: channel, keyword (null without keywords), page_no (0: the landing page) and html.  Rows have `type`: error (with
    `error`), channel (title, about, subscribers: the landing page's where it has them) and post (with its keyword).  Pages taken
    apart, and the rows of each search, are written as tables, which stay for the rows that are read from them.
    """
    kept = Steps(channels.sparkSession, "channel-feed")
    read = kept.put(read_pages(pages))  # each page is taken apart once
    searches = keywords or [None]
    is_search = lambda k: F.col("keyword").eqNullSafe(F.lit(k).cast("string"))
    first = read.where((F.col("page_no") == 1) & is_search(searches[0])).select("channel", "kind", F.col("page.name").alias("title"), F.col("page.about").alias("about"), "subscribers")
    landing = read.where("page_no = 0").groupBy("channel").agg(F.max("subscribers").alias("__exact"))
    known = channels.join(first, "channel", "left").withColumn("kind", F.coalesce("kind", F.lit("notFound")))
    error = F.when(F.col("channel").isNull(), "invalidInput")
    for kind, code in ERRORS.items():
        error = error.when(F.col("kind") == kind, code)
    known = known.withColumn("error", error)
    failed = known.where("error is not null").select(F.lit("error").alias("type"), F.coalesce("channel", "input").alias("channel"), "error")
    open_ = known.where("error is null")
    about = open_.join(landing, "channel", "left").select(F.lit("channel").alias("type"), "channel", squash("title").alias("title"), "about", F.coalesce("__exact", "subscribers").alias("subscribers"))

    posts = posts_of(read.where("page_no > 0 and kind = 'preview'")).join(open_.select("channel"), "channel", "left_semi")
    out, ends, marks = None, [], []
    for i, k in enumerate(searches):
        rows = kept.put(search_posts(posts.where(is_search(k)), out, seen, since, most, streak))
        ends.append(rows.groupBy("channel").agg(F.max("ended").alias("ended")).withColumn("search", F.lit(i)))
        marks.append(rows)
        fresh = rows.where("fresh").drop("fresh", "ended", "place")
        out = fresh if out is None else out.unionByName(fresh)
    status = open_.select("channel", F.explode(F.sequence(F.lit(0), F.lit(len(searches) - 1))).alias("search"))
    all_ends = ends[0]
    for e in ends[1:]:
        all_ends = all_ends.unionByName(e)
    status = status.join(all_ends, ["channel", "search"], "left").withColumn("ended", F.coalesce("ended", F.lit("exhausted")))
    read_now = marks[0].select("channel", "post_id")
    for m in marks[1:]:
        read_now = read_now.unionByName(m.select("channel", "post_id"))
    touched = join_keys(read_now.distinct(), seen.select("channel", "post_id").distinct(), ["channel", "post_id"], "left_semi").unionByName(out.select("channel", "post_id")).distinct()
    rows = failed.unionByName(about, allowMissingColumns=True).unionByName(out.withColumn("type", F.lit("post")), allowMissingColumns=True)
    return rows, status, touched

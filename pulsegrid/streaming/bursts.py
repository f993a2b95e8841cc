"""Edit bursts: articles that many people edit within minutes, in batch and as a stateful stream."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.robust import array_median, bitmap
from pulsegrid.params import Bursts


def maintenance(comment) -> F.Column:
    """Summaries of reverts and routine edits (fixed values: the patterns)."""
    patterns = r"\brevert|\bundo\b|\bundid\b|\brollback\b|^rv\b|\brv\s|reverted edits|undid revision|\bAWB\b|\bHotCat\b|\bTwinkle\b|\bhuggle\b|\bIABot\b|InternetArchiveBot|\bWPCleaner\b|^\s*\{\{[^}]*\}\}\s*$|\btypos?\b|fix typo|copyedit"
    return F.coalesce(comment.rlike("(?i)" + patterns), F.lit(False))


def wiki_baselines(edits: DataFrame, p: Bursts = Bursts()) -> DataFrame:
    """(lang, hour, baseline): the median of the last hourly medians of edits an edited article, before the hour;
    one until enough hours exist. edits has lang, title and second (epoch)."""
    hours = edits.groupBy("lang", "title", F.expr("second div 3600").alias("hour")).agg(F.count("*").alias("n"))
    hours = hours.groupBy("lang", "hour").agg(F.median("n").alias("middle"))
    before = Window.partitionBy("lang").orderBy("hour").rowsBetween(-p.baseline_hours, -1)
    rows = hours.withColumn("past", F.collect_list("middle").over(before))
    return rows.select("lang", "hour", F.when(F.size("past") >= p.baseline_min_hours, array_median(F.col("past"))).otherwise(1.0).alias("baseline"))


FOUND = "lang string, title string, second long, kind string, n_edits long, n_editors int"
#: Seconds of an article that one task counts over; a multiple of no window, only longer than each.
BLOCK = 86400


def window_counts(edits: DataFrame, span: int) -> DataFrame:
    """(lang, title, second, n_edits, n_editors): the edits and distinct editors of the last span seconds, at each second that
    has an edit. An edit counts from its second until span is over, its editor until then or until the same editor's next
    edit; both are running sums of ones that come and go. Sums run over one block of time of an article, into which what is
    still open at its begin is carried, so no task needs an article's history. Edits without a user count, but not as editors."""
    block = max(BLOCK, span)
    per = edits.groupBy("lang", "title", "second", "user").agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang", "title", "user", F.when(F.col("user").isNull(), F.col("second"))).orderBy("second")
    per = per.withColumns({"end": F.col("second") + span, "e": F.col("user").isNotNull().cast("int"), "gone": F.least(F.col("second") + span, F.lead("second").over(own))})
    at = lambda t, n, e, edit: F.struct(F.floor(t / block).alias("block"), t.alias("second"), n.alias("n"), e.alias("e"), F.lit(edit).alias("edit"))
    zero, s, n, e = F.lit(0).cast("long"), F.col("second"), F.col("n"), F.col("e")
    border = (F.floor(s / block) + 1) * block
    points = F.array(
        at(s, n, e, True), at(F.col("end"), -n, F.lit(0), False), at(F.col("gone"), zero, -e, False),
        F.when(F.col("end") >= border, at(border, n, F.lit(0), False)), F.when(F.col("gone") >= border, at(border, zero, e, False)),
    )
    rows = per.select("lang", "title", F.explode(F.filter(points, lambda x: x.isNotNull())).alias("x")).select("lang", "title", "x.*")
    upto = Window.partitionBy("lang", "title", "block").orderBy("second").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"n_edits": F.sum("n").over(upto), "n_editors": F.sum("e").over(upto).cast("int")})
    return rows.filter("edit").select("lang", "title", "second", "n_edits", "n_editors")


def new_page_counts(edits: DataFrame, fresh: int) -> DataFrame:
    """(lang, title, second, n_edits, n_editors): edits and editors since the page was created, up to fresh seconds on."""
    made = edits.filter("is_new").groupBy("lang", "title").agg(F.min("second").alias("created"))
    since = edits.join(made, ["lang", "title"]).filter((F.col("second") >= F.col("created")) & (F.col("second") <= F.col("created") + fresh))
    per = since.groupBy("lang", "title", "second", "user").agg(F.count("*").alias("n"))
    first = F.col("user").isNotNull() & (F.row_number().over(Window.partitionBy("lang", "title", "user").orderBy("second")) == 1)
    upto = Window.partitionBy("lang", "title").orderBy("second").rangeBetween(Window.unboundedPreceding, 0)
    rows = per.withColumn("first", first.cast("int"))
    return rows.select("lang", "title", "second", F.sum("n").over(upto).alias("n_edits"), F.sum("first").over(upto).cast("int").alias("n_editors"))


def after_cooldown(found: DataFrame, cooldown: int) -> DataFrame:
    """Of the seconds that meet a rule, the first of each article and then always the next one that is a cooldown later. One that
    comes a cooldown after the second before it is free whatever was taken before; such seconds part an article's into runs, each
    walked in one pass. A run holds its seconds only, one at most for each second that it lasts."""
    order = Window.partitionBy("lang", "title").orderBy("second")
    gap = F.col("second") - F.lag("second").over(order)
    rows = found.withColumn("run", F.sum(F.when(gap < cooldown, 0).otherwise(1)).over(order))
    each = F.array_sort(F.collect_list(F.struct("second", "kind", "n_edits", "n_editors")))
    runs = rows.groupBy("lang", "title", "run").agg(each.alias("xs"))
    taken = f"""aggregate(xs, CAST(array() AS array<struct<second: bigint, kind: string, n_edits: bigint, n_editors: int>>),
        (took, x) -> CASE WHEN size(took) = 0 OR x.second >= took[size(took) - 1].second + {cooldown} THEN concat(took, array(x)) ELSE took END)"""
    return runs.select("lang", "title", F.inline(F.expr(taken)))


def bursts(edits: DataFrame, p: Bursts = Bursts()) -> DataFrame:
    """Bursts of edits (lang, title, second, user, and is_new where known): many edits by several editors within the window, against
    the wiki's baseline, or on a page created shortly before; at most one in a cooldown."""
    counts = window_counts(edits, 60 * p.window_minutes).filter((F.col("n_edits") >= p.min_edits) & (F.col("n_editors") >= p.min_editors))
    counts = counts.withColumn("hour", F.expr("second div 3600")).join(wiki_baselines(edits, p), ["lang", "hour"])
    columns = ("lang", "title", "second", "n_edits", "n_editors")
    found = counts.filter(2 * F.col("n_edits") >= p.ratio * F.col("baseline")).select(*columns, F.lit(0).alias("rank"), F.lit("window").alias("kind"))
    if "is_new" in edits.columns:
        fresh = new_page_counts(edits, 60 * p.new_page_minutes)
        fresh = fresh.filter((F.col("n_edits") >= p.new_page_edits) & (F.col("n_editors") >= p.new_page_editors))
        found = found.unionByName(fresh.select(*columns, F.lit(1).alias("rank"), F.lit("new").alias("kind")))
    one = found.groupBy("lang", "title", "second").agg(F.min(F.struct("rank", "kind", "n_edits", "n_editors")).alias("x"))
    return after_cooldown(one.select("lang", "title", "second", "x.kind", "x.n_edits", "x.n_editors"), 3600 * p.cooldown_hours)


class Detector:
    """The burst rules for one article of a stream: the edits of the longest window, the last burst, and when the page was created. Its
    size is that of one window, whatever the article's history."""

    def __init__(self, p: Bursts, held: list[tuple[int, str | None]] | None = None, last: int | None = None, created: int | None = None):
        self.p, self.held, self.last, self.created = p, deque(held or []), last, created
        self.span, self.fresh = 60 * p.window_minutes, 60 * p.new_page_minutes

    def at(self, second: int, users: list[str | None], baseline: float) -> tuple[int, str, int, int] | None:
        """Take the edits of one second; the burst that they make, if any. Edits without a user count, but not as editors."""
        self.held.extend((second, u) for u in users)
        young = self.created is not None and 0 <= second - self.created <= self.fresh
        begin = min(second - self.span + 1, self.created if young else second)
        while self.held and self.held[0][0] < begin:
            self.held.popleft()
        if self.last is not None and second - self.last < 3600 * self.p.cooldown_hours:
            return None
        for kind, low, edits, editors in (("window", second - self.span + 1, self.p.min_edits, self.p.min_editors), ("new", self.created, self.p.new_page_edits, self.p.new_page_editors)):
            if kind == "new" and not young:
                continue
            recent = [u for s, u in self.held if s >= low]
            people = len({u for u in recent if u is not None})
            if len(recent) >= edits and people >= editors and (kind == "new" or 2 * len(recent) >= self.p.ratio * baseline):
                self.last = second
                return second, kind, len(recent), people
        return None


def live_events(found: DataFrame, group_minutes: int = 120) -> DataFrame:
    """Entities that burst in two languages, one soon after the other: (qid, second, first, languages). found has
    qid, lang and second."""
    firsts = found.filter("qid IS NOT NULL").groupBy("qid", "lang").agg(F.min("second").alias("s"))
    order = Window.partitionBy("qid").orderBy("s", "lang")
    rows = firsts.withColumn("gap", F.col("s") - F.lag("s").over(order))
    out = rows.groupBy("qid").agg(F.min(F.when(F.col("gap") <= 60 * group_minutes, F.col("s"))).alias("second"), F.min("s").alias("first"), F.count("*").alias("languages"))
    return out.filter("second IS NOT NULL")


def live_view(found: DataFrame, now: int, minutes: int = 60, singles: int = 5, keep_hours: int = 72) -> DataFrame:
    """What is on now: bursts of the last minutes before now (a second), those of entities that burst in several languages as events, and
    of the others the strongest by editors, edits and time; bursts older than keep_hours are gone. found has qid, lang, title, second, n_edits, n_editors."""
    kept = found.filter((F.col("second") > now - 3600 * keep_hours) & (F.col("second") <= now))
    live = live_events(kept.select("qid", "lang", "second")).select("qid", F.lit("event").alias("kind"))
    recent = kept.filter(F.col("second") > now - 60 * minutes).join(live, "qid", "left").withColumn("kind", F.coalesce("kind", F.lit("single")))
    top = recent.filter("kind = 'single'").orderBy(F.desc("n_editors"), F.desc("n_edits"), F.desc("second"), "lang", "title").limit(singles)
    return recent.filter("kind = 'event'").unionByName(top)


def with_entities(found: DataFrame, links: DataFrame) -> DataFrame:
    """found with qid filled in where links came later than the burst."""
    late = links.select("lang", "title", F.col("qid").alias("found_qid"))
    return found.join(late, ["lang", "title"], "left").withColumn("qid", F.coalesce("qid", "found_qid")).drop("found_qid")


def hourly_counts(reads: DataFrame, late: str = "1 hour") -> DataFrame:
    """Closed hours of a stream of reads (time, lang, title, v, is_mobile): sums of an hour once it can't change any more."""
    rows = reads.withWatermark("time", late).groupBy(F.window("time", "1 hour").alias("w"), "lang", "title")
    sums = rows.agg(F.sum(F.when(~F.col("is_mobile"), F.col("v")).otherwise(0)).alias("views_desktop"), F.sum(F.when(F.col("is_mobile"), F.col("v")).otherwise(0)).alias("views_mobile"))
    return sums.select(F.col("w.start").alias("ts_hour"), "lang", "title", "views_desktop", "views_mobile")


def article_edits(changes: DataFrame, wikis: DataFrame) -> DataFrame:
    """Edits and new pages of articles by people: known wikis (wiki, lang; a fixed table), no bots, no maintenance."""
    rows = changes.filter((F.col("namespace") == 0) & F.col("type").isin("edit", "new") & ~F.col("bot") & ~_reverted(F.col("tags")) & ~maintenance(F.col("comment")))
    rows = rows.join(F.broadcast(wikis), "wiki")
    return rows.withColumn("time", F.coalesce(F.timestamp_seconds("timestamp"), F.to_timestamp("dt")))


def _reverted(tags) -> F.Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, ("mw-reverted", "mw-rollback", "mw-undo", "mw-manual-revert"))))


def historical_revisions(rows: DataFrame) -> DataFrame:
    """Past revisions that count as edits of people: no user named as a bot, no revert, no maintenance."""
    return rows.filter(~F.lower(F.coalesce("user", F.lit(""))).endswith("bot") & ~_reverted(F.col("tags")) & ~maintenance(F.col("comment")))


def hashed_user(user, salt: str) -> F.Column:
    """What is kept of a user: a salted hash, never the name."""
    return F.sha2(F.concat(F.lit(salt), user), 256)


def sliding_windows(edits: DataFrame, user: F.Column, sizes: tuple[int, ...] = (10, 30, 60), pane: int = 5, late: str = "1 hour", bits: int = 63) -> DataFrame:
    """(minutes, start, lang, title, n, bits) of a stream of edits (time, lang, title): counts and user bitmaps of windows of so many
    minutes, one every pane. Edits meet once, in panes; a window sums its panes' counts and or-s their bitmaps. Windows that end
    together are one group: the shorter ones are the last panes of the longest."""
    panes = edits.withWatermark("time", late).groupBy(F.window("time", f"{pane} minutes").alias("w"), "lang", "title").agg(F.count("*").alias("n"), bitmap(user, bits).alias("bits"))
    panes = panes.select(F.window_time("w").alias("time"), "lang", "title", "n", "bits").withColumn("w", F.window("time", f"{max(sizes)} minutes", f"{pane} minutes"))
    last = {k: F.col("time") >= F.col("w.end") - F.expr(f"INTERVAL {k} MINUTES") for k in sizes}
    sums = [x for k in sizes for x in (F.sum(F.when(last[k], F.col("n"))).alias(f"n{k}"), F.bit_or(F.when(last[k], F.col("bits"))).alias(f"b{k}"))]
    found = panes.groupBy("w", "lang", "title").agg(*sums)
    each = F.array(*[F.struct(F.lit(k).alias("minutes"), (F.col("w.end") - F.expr(f"INTERVAL {k} MINUTES")).alias("start"), F.col(f"n{k}").alias("n"), F.col(f"b{k}").alias("bits")) for k in sizes])
    rows = found.select("lang", "title", F.explode(each).alias("x")).select("x.minutes", "x.start", "lang", "title", "x.n", "x.bits")
    return rows.filter("n IS NOT NULL")

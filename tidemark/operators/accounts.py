"""Usage, quotas, retention and session lists over account tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import period_next, period_start
from tidemark.operators.ordered import bucketed, running
from tidemark.plans.lineage import dropped, stored

# Days from the lapse of a subscription to deletion, days and hours before deletion of the two
# warnings, hours between two steps, and the states that protect a user.
DELETE_AFTER_DAYS, FIRST_WARNING_DAYS, SECOND_WARNING_HOURS, GAP_HOURS, STALE_DAYS = 30, 7, 24, 24, 180
PROTECTED = ("active", "trialing", "past_due")
FAILED = ("bounced", "complained")


def newest_active(subscriptions: DataFrame) -> DataFrame:
    """The newest active subscription of each user."""
    active = subscriptions.where("status = 'active'")
    return active.groupBy("user_id").agg(F.max_by(F.struct("id", "started_at"), F.struct("created_at", "id")).alias("_s")).select("user_id", "_s.*")


def current_period(users: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """(user_id, start, next): the monthly period on the subscription's anniversary, else the calendar month."""
    both = users.select("user_id").join(newest_active(subscriptions), "user_id", "left")
    month = F.trunc(now, "month")
    return both.select("user_id", F.coalesce(period_start(F.col("started_at"), now), month).alias("start"), F.coalesce(period_next(F.col("started_at"), now), F.add_months(month, 1)).alias("next"))


def usage(events: DataFrame, periods: DataFrame, amount: str, at: str) -> DataFrame:
    """(user_id, used): the sum of the amounts since the start of each user's period; 0 without any."""
    inside = events.join(periods, "user_id").where(F.col(at) >= F.col("start")).groupBy("user_id").agg(F.sum(amount).alias("used"))
    return periods.select("user_id").join(inside, "user_id", "left").select("user_id", F.coalesce("used", F.lit(0)).alias("used"))


def quota(used: DataFrame, limits: DataFrame) -> DataFrame:
    """(user_id, used, quota, allowed, remaining); a limit below 0 means none, no limit at all means nothing is allowed."""
    both = used.join(limits, "user_id", "left")
    free = F.col("quota") < 0
    return both.select("user_id", "used", "quota", F.coalesce(free | (F.col("used") < F.col("quota")), F.lit(False)).alias("allowed"), F.when(~free, F.greatest(F.col("quota") - F.col("used"), F.lit(0))).alias("remaining"))


#: Amounts are exact to six places.
AMOUNT = "decimal(28,6)"


def admit(requests: DataFrame, limits: DataFrame, amount: str, at: str, key: str) -> DataFrame:
    """requests with admitted and used: in the order of (at, key) an amount counts if what counted before leaves room for it.

    requests: user_id, the time `at` and a key that tells requests of one time apart. limits: (user_id, quota); below 0
    means no limit, null or no row that nothing is admitted. A null or negative amount isn't admitted. used: what the
    user's admitted amounts add up to, this one included.

    An admission depends on all before it, but not one by one. With room r, amounts of at most r/2 all count until they
    have taken half of r, whatever else happens; a larger one counts if it fits beside those before it, and the first to do so ends
    the round as well. Both are known from running sums over time buckets, and either leaves less than r/2. So all
    requests up to that one are settled in one round for all users, rooms halve in each round, and there are about
    log2(largest quota / smallest amount) rounds at most; amounts above the room left never count.
    """
    position = F.struct(F.col(at).alias("at"), F.col(key).alias("key"))
    rows = requests.join(limits.select("user_id", F.col("quota").cast(AMOUNT).alias("_quota")), "user_id", "left").withColumn("_amount", F.col(amount).cast(AMOUNT))
    asked = rows.where("_amount >= 0 and _quota >= 0 and _amount <= _quota").select("user_id", F.col(at).alias("ts"), F.col(key).alias("row_pos"), "_amount", position.alias("_at"), "_quota")
    asked = stored(bucketed(asked), "requests")
    rooms = stored(asked.groupBy("user_id").agg(F.first("_quota").alias("_room"), F.lit(None).cast(asked.schema["_at"].dataType).alias("_after")), "rooms")
    settled = []
    while not rooms.isEmpty():
        left = asked.join(rooms, "user_id").where((F.col("_after").isNull() | (F.col("_at") > F.col("_after"))) & (F.col("_amount") <= F.col("_room")))
        small = F.col("_amount") * 2 <= F.col("_room")
        summed = running(left, "_through", F.when(small, F.col("_amount")).otherwise(F.lit(0).cast(AMOUNT)), ["ts", "row_pos"], "user_id")
        ends = F.when(small, F.col("_through") * 2 > F.col("_room")).otherwise(F.col("_through") + F.col("_amount") <= F.col("_room"))
        summed = stored(summed.select("user_id", "_at", "_amount", "_room", small.alias("_small"), ends.alias("_ends")), "round")
        first = summed.where("_ends").groupBy("user_id").agg(F.min("_at").alias("_end"))
        got = summed.join(first, "user_id", "left").where(F.col("_end").isNull() & F.col("_small") | (F.col("_at") < F.col("_end")) & F.col("_small") | (F.col("_at") == F.col("_end")))
        got = stored(got.select("user_id", "_at", "_amount", "_room", "_end"), "admitted")
        settled.append(got)
        later = got.where("_end is not null").groupBy("user_id").agg((F.first("_room") - F.sum("_amount")).cast(AMOUNT).alias("_room"), F.first("_end").alias("_after"))
        later = stored(later, "rooms")
        dropped(rooms, summed)
        rooms = later
    dropped(rooms, asked)
    fits = F.col("_quota") < 0
    marks = None
    for got in settled:
        got = got.select("user_id", F.col("_at.at").alias(at), F.col("_at.key").alias(key), F.lit(True).alias("_fits"))
        marks = got if marks is None else marks.unionAll(got)
    rows = rows.withColumn("_fits", F.lit(None).cast("boolean")) if marks is None else rows.join(marks, ["user_id", at, key], "left")
    rows = rows.withColumn("admitted", F.coalesce((F.col("_amount") >= 0) & (fits | F.coalesce("_fits", F.lit(False))), F.lit(False)))
    counted = F.when(F.col("admitted"), F.col("_amount")).otherwise(F.lit(0).cast(AMOUNT))
    return running(bucketed(rows, ts=at), "used", counted, [at, key], "user_id").select(*requests.columns, "admitted", "used")


def retention_actions(subscriptions: DataFrame, notices: DataFrame, now: Column) -> DataFrame:
    """(user_id, subscription_id, action, deletion_date) for users of whom something is due.

    Nobody with a protecting subscription; of the others the one that lapsed last counts, unless its data are
    deleted or a warning came back. The first warning comes 7 days before deletion, the second a day before it,
    deletion a day after the second at the earliest; once scheduled, the scheduled date holds.
    """
    days = lambda c, n: c + F.make_dt_interval(F.lit(n))
    hours = lambda c, n: c + F.make_dt_interval(F.lit(0), F.lit(n))
    lapse = F.col("expires_at")
    newest = F.max_by(F.struct("id", "expires_at", "scheduled_deletion_at", "data_deleted_at"), F.struct(F.coalesce(lapse, F.lit("0001-01-01").cast("timestamp")), "id"))
    users = subscriptions.groupBy("user_id").agg(F.bool_or(F.col("status").isin(*PROTECTED) & (lapse.isNull() | (lapse > now))).alias("safe"), newest.alias("s"))
    users = users.where("not coalesce(safe, false) and s.data_deleted_at is null and s.expires_at is not null")
    told = notices.groupBy("subscription_id", "kind").agg(F.max_by(F.struct("status", "sent_at"), F.coalesce("sent_at", F.lit("0001-01-01").cast("timestamp"))).alias("n"))
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n")))
    both = users.join(told.groupBy("subscription_id").agg(last("warn1").alias("w1"), last("warn2").alias("w2")), F.col("s.id") == F.col("subscription_id"), "left")
    failed = lambda w: F.coalesce(F.col(f"{w}.status").isin(*FAILED), F.lit(False))
    due = days(F.col("s.expires_at"), DELETE_AFTER_DAYS)
    date, sent1, sent2 = F.coalesce(F.col("s.scheduled_deletion_at"), due), F.col("w1.sent_at"), F.col("w2.sent_at")
    action = (
        F.when(sent1.isNull(), F.when(now >= days(due, -FIRST_WARNING_DAYS), "warn1"))
        .when(sent2.isNull(), F.when(now >= F.greatest(hours(date, -SECOND_WARNING_HOURS), hours(sent1, GAP_HOURS)), "warn2"))
        .otherwise(F.when(now >= F.greatest(date, hours(sent2, GAP_HOURS)), "delete"))
    )
    out = both.where(~failed("w1") & ~failed("w2")).select("user_id", F.col("s.id").alias("subscription_id"), action.alias("action"), date.alias("deletion_date"))
    return out.where("action is not null")


def stale_users(sessions: DataFrame, subscriptions: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """(user_id, last_at): users without any subscription whose newest session is older than that."""
    last = sessions.join(subscriptions.select("user_id"), "user_id", "left_anti").groupBy("user_id").agg(F.max("created_at").alias("last_at"))
    return last.where(F.datediff(now, F.col("last_at")) > days)


def session_list(sessions: DataFrame, files: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Each session with the number of its files and the files as a JSON array, in order."""
    item = F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("_f"))))
    listed = files.groupBy(key).agg(F.count("*").alias("n_files"), F.to_json(F.transform(item, lambda x: x._f)).alias("files"))
    return sessions.join(listed, key, "left").withColumns({"n_files": F.coalesce("n_files", F.lit(0)), "files": F.coalesce("files", F.lit("[]"))})


# Training runs a month by plan; -1 stands for no limit.
TRAINING_RUNS = {"Free": 0, "Pro": 5, "Enterprise": -1}


def fill_training_limits(plans: DataFrame, name: str = "name", limit: str = "max_runs") -> DataFrame:
    """Plans whose limit is null or 0 get that of their name, unknown names 0; other limits stay."""
    known = F.lit(0)
    for plan, runs in TRAINING_RUNS.items():
        known = F.when(F.col(name) == plan, runs).otherwise(known)
    return plans.withColumn(limit, F.when(F.coalesce(F.col(limit), F.lit(0)) == 0, known).otherwise(F.col(limit)))

"""User reports: counters, lists, paged search, CSV export lines, activity."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.calendar import ntz_literal, ts_label
from ledgerflow.functions.labels import login_type_or_default, role_or_default
from ledgerflow.operators.pages import Pages, paged
from ledgerflow.schemas import MISSING_TEXT, USERS_PER_PAGE


def with_user_defaults(users: DataFrame) -> DataFrame:
    return users.withColumns({"login_type": login_type_or_default("login_type"),
                              "role": role_or_default("role")})


def user_stats(users: DataFrame, now: _dt.datetime) -> DataFrame:
    """Total, created today, created in the last 7 days (from midnight 7 days ago),
    Google, e-mail (null or empty login type counts as e-mail) and admin users, in
    one aggregate pass. ``now`` is an argument so results are reproducible."""
    today = now.date()
    week_ago = today - _dt.timedelta(days=7)
    lt = F.col("login_type")
    return users.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if(F.to_date("created_at") == F.lit(today)).alias("new_today"),
        F.count_if(F.col("created_at") >= ntz_literal(_dt.datetime.combine(week_ago, _dt.time())))
         .alias("active_week"),
        F.count_if(lt == "google").alias("google_users"),
        F.count_if((lt == "email") | lt.isNull() | (lt == "")).alias("email_users"),
        F.count_if(F.col("role") == "admin").alias("admin_count"),
    )


def list_users(users: DataFrame) -> DataFrame:
    """All users, newest id first, defaults applied, minute-format creation time."""
    u = with_user_defaults(users)
    return u.select("id", "firstname", "lastname", "email", ts_label("created_at").alias("created_at"),
                    "login_type", "role").orderBy(F.desc("id"))


def export_lines(users: DataFrame) -> DataFrame:
    """CSV lines of the user export, ordered by id, no quoting.

    Missing values print as ``None``, as the original string formatting does.
    """
    u = with_user_defaults(users)

    def txt(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TEXT))

    line = F.concat_ws(",", txt("id"), txt("firstname"), txt("lastname"), txt("email"), txt("role"),
                       txt("login_type"), F.coalesce(ts_label("created_at"), F.lit(MISSING_TEXT)))
    return u.select("id", line.alias("line")).orderBy("id")


def search_filter(users: DataFrame, text: str | None) -> DataFrame:
    if not text:
        return users
    t = text.strip().lower()
    cond = F.lit(False)
    for c in ["firstname", "lastname", "email"]:
        cond = cond | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(t)), F.lit(False))
    return users.where(cond)


def search_users(users: DataFrame, text: str | None, page: int = 1,
                 per_page: int = USERS_PER_PAGE) -> DataFrame:
    """One page of matching users, ordered by id (offset + limit)."""
    u = with_user_defaults(search_filter(users, text))
    page = max(int(page), 1)
    return (u.orderBy("id").offset((page - 1) * per_page).limit(per_page)
            .select("id", "firstname", "lastname", "email", "role", "login_type",
                    ts_label("created_at").alias("created_at")))


def search_pages(users: DataFrame, text: str | None) -> Pages:
    """All matching users stored in the order of their ids, for pages at any depth (:meth:`Pages.page`)."""
    u = with_user_defaults(search_filter(users, text))
    return paged(u.select("id", "firstname", "lastname", "email", "role", "login_type", ts_label("created_at").alias("created_at")), ["id"])


def search_total(users: DataFrame, text: str | None, per_page: int = USERS_PER_PAGE) -> DataFrame:
    """One row: matching users and page count."""
    n = F.count(F.lit(1))
    return search_filter(users, text).agg(
        n.alias("total"), F.ceil(n / F.lit(per_page)).cast("long").alias("pages"))


def registrations_daily(users: DataFrame) -> DataFrame:
    return (users.groupBy(F.to_date("created_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("n_users")).orderBy("day"))


def login_split(users: DataFrame) -> DataFrame:
    return (users.groupBy(login_type_or_default("login_type").alias("login_type"))
            .agg(F.count(F.lit(1)).alias("n_users")))


def activity_weekly(activity: DataFrame) -> DataFrame:
    """Distinct active users per ISO week (week starting Monday).

    ``count(distinct)`` is planned as two aggregations, (week, user) then week,
    both with map-side partial steps, so no week is gathered raw into one task.
    """
    return (activity.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week_start"))
            .agg(F.count_distinct("user_id").alias("active_users")))

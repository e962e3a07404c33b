"""Queries of whole orders and of their first rows."""

from __future__ import annotations

from quire.operators import library as li
from quire.plans.base import on

on("books", "ord_library", "SELECT uid, row_number() OVER (ORDER BY ord, title, uid) AS place FROM books", lambda b: li.places(b, *li.ORDER).select("uid", "place"))
on("events", "ord_recent", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events", lambda e: li.places(e.select("event_id", "ts"), *li.recent_order()).select("event_id", "place"))
# the sort key is of the root collation in both, ICU's
on("books", "ord_title", "SELECT uid, row_number() OVER (ORDER BY icu_sort_key(title, 'root'), ord, title, uid) AS place FROM books", lambda b: li.places(b, *li.title_order()).select("uid", "place"))
on("books", "ord_title_bytes", "SELECT uid, row_number() OVER (ORDER BY title, ord, uid) AS place FROM books", lambda b: li.places(b, *li.title_order(locale=False)).select("uid", "place"))
on("books", "ord_author_bytes", "SELECT uid, row_number() OVER (ORDER BY author, title, ord, uid) AS place FROM books", lambda b: li.places(b, *li.author_order(locale=False)).select("uid", "place"))
on("books", "ord_author", "SELECT uid, row_number() OVER (ORDER BY icu_sort_key(author, 'root'), icu_sort_key(title, 'root'), ord, title, uid) AS place FROM books", lambda b: li.places(b, *li.author_order()).select("uid", "place"))
on("books", "top_more", "SELECT uid FROM books WHERE uid <> 3 ORDER BY ord, title, uid LIMIT 4", lambda b: li.others(b, 3).select("uid"))
on("books", "top_shelf", ", top AS (SELECT uid, row_number() OVER (ORDER BY ord, title, uid) - 1 AS slot FROM books WHERE cover_url IS NOT NULL ORDER BY slot LIMIT 4) SELECT s.slot, uid FROM (SELECT unnest(range(4)) AS slot) s LEFT JOIN top ON s.slot = top.slot", lambda b: li.shelf(b).select("slot", "uid"))
on("books", "top_random_pick", None, lambda b: li.random_pick(b, 7).select("uid"))
on("books", "top_first_value", "SELECT coalesce((SELECT title FROM books WHERE language = 'fr' ORDER BY uid LIMIT 1), 'none') AS title", lambda b: li.first_or(li.of_language(b, "fr"), "uid", "title", "none"))

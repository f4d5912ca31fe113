"""Day-by-day plans: days, themes, Markdown, and Markdown taken apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.functions.numeric import half_even
from roamer.operators.catalog import INTEREST_COLUMNS

# Special days and one kind of day for each interest: (key, title, morning, afternoon, evening). Our own wording.
THEMES = [
    ("arrival", "First steps", "Arrive, drop the bags and look around near your stay in {city}", "Wander the central streets with no list", "Eat close by and turn in early"),
    ("local", "Everyday life", "Have coffee where the neighbours do", "Look into side streets, small shops and a lesser-known sight", "Dine away from the busy squares"),
    ("excursion", "Out of town", "Ride out to a town, shore or valley nearby", "Give the whole day to the trip", "Come back to a plain meal near your stay"),
    ("slower", "An easy pace", "Sleep long and go back to a place you liked", "Pick one thing to do and leave the rest open", "Watch the evening from somewhere with a view"),
    ("farewell", "Last looks", "Return to a favourite or look for gifts", "Take one more walk and leave time for the way home", "Close with a dinner that sums up the trip"),
    ("beach", "By the water", "Walk to the shore before it fills", "Swim, sail or follow the coast", "Stay for the sunset and eat fish"),
    ("culture", "Old and new stories", "See the best-known old quarter early", "Spend hours in a museum or among fine buildings", "Stroll through lit streets"),
    ("nature", "Parks and heights", "Start in a garden or on a woodland path", "Climb to a viewpoint", "Walk home along water or quiet lanes"),
    ("nightlife", "Late hours", "Rise late and browse a lively quarter", "Visit studios, shops or a busy square", "Hear music and stay out"),
    ("food", "Tastes of the place", "Breakfast at a market", "Try local dishes on a tasting walk", "Book a table for the local speciality"),
    ("adventure", "Something bold", "Set out with a guide", "Hike, paddle or cycle", "Rest over a long meal"),
    ("relaxation", "Unhurried", "Take breakfast slowly and find a spa", "Sit in a peaceful corner or walk gently", "Dine with nothing planned after"),
]
# Fixed value: the heading that ends the days.
NOTES = "### Practical notes"


def theme_table(spark: SparkSession) -> DataFrame:
    """Twelve rows, so it may be broadcast."""
    return spark.createDataFrame(THEMES, "theme string, title string, morning string, afternoon string, evening string")


def ranked_interests() -> Column:
    """Interest names by the profile's value, ties in the order of the list."""
    each = F.array(*[F.struct((-F.col(c)).alias("low"), F.lit(i).alias("at"), F.lit(c).alias("name")) for i, c in enumerate(INTEREST_COLUMNS)])
    return F.transform(F.array_sort(each), lambda s: s["name"])


def plan_days(trips: DataFrame) -> DataFrame:
    """A row for each day of each trip (start_date, end_date), with ``days`` and ``day`` from 1; none if it ends before it starts."""
    days = trips.withColumn("days", F.datediff("end_date", "start_date") + 1).where("days >= 1")
    return days.withColumn("day", F.explode(F.sequence(F.lit(1), F.col("days"))))


def plan_themes(days: DataFrame) -> DataFrame:
    """The theme of each day; the first rule that fits. Needs the profile's interests."""
    day, n = F.col("day"), F.col("days")
    ranked = days.withColumn("__ranked", ranked_interests())
    theme = (F.when(day == 1, "arrival").when(day == n, "farewell").when((n >= 5) & (day == n - 1), "slower")
             .when((n >= 4) & (day == F.greatest(F.lit(3), F.floor(n / 2).cast("int"))), "excursion").when((day > 7) & (day % 4 == 0), "local")
             .otherwise(F.element_at("__ranked", F.pmod(day - 2, F.lit(len(INTEREST_COLUMNS))) + 1)))
    return ranked.withColumn("theme", theme).drop("__ranked")


def plan_markdown(themed: DataFrame, key: str = "profile_id") -> DataFrame:
    """One Markdown text a trip from its themed days (city, country, avg_temp_c, period or null, interests)."""
    t = themed.join(F.broadcast(theme_table(themed.sparkSession)), "theme")
    fill = lambda c: F.replace(F.col(c), F.lit("{city}"), F.col("city"))
    block = F.concat(F.lit("## Day "), F.col("day").cast("string"), F.lit(" - "), "title", F.lit("\n**Morning:** "), fill("morning"), F.lit(".\n\n**Afternoon:** "), fill("afternoon"),
                     F.lit(".\n\n**Evening:** "), fill("evening"), F.lit(".\n\n"))
    top = F.array_join(F.slice(ranked_interests(), 1, 3), ", ")
    when = F.coalesce(F.concat(F.lit(" during "), F.col("period")), F.lit(""))
    head = F.concat(F.lit("### Your "), "city", F.lit(" trip\n\nA "), F.col("days").cast("string"), F.lit("-day plan for "), "city", F.lit(", "), "country", when,
                    F.lit(", built around "), top, F.lit(". It starts gently and ends with time to spare.\n\n"))
    tail = F.concat(F.lit(f"{NOTES}\n- Expect about "), F.format_string("%.1f", half_even("avg_temp_c", 1)),
                    F.lit(" C on average.\n- Leave one part of each day open.\n- Book big outings and dinners early."))
    rows = t.select(key, "day", block.alias("block"), head.alias("head"), tail.alias("tail"))
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("day", "block"))).alias("b"), F.any_value("head").alias("head"), F.any_value("tail").alias("tail"))
    return whole.select(key, F.concat("head", F.array_join(F.transform("b", lambda x: x["block"]), ""), "tail").alias("markdown"))


_TRIM = r"^\s+|\s+$"


def plan_parse(plans: DataFrame, key: str = "profile_id") -> DataFrame:
    """I4: the parts of Markdown texts: (key, part, position, title, body). ``intro`` (position 0) if it is not blank, ``day`` for
    each heading ``## Day n``, ``notes`` if the notes' heading stands there. Text without days is all introduction; a null text has no parts.
    """
    strip = lambda c: F.regexp_replace(c, _TRIM, "")
    at = F.locate(NOTES, F.col("markdown"))
    main = F.when(at > 0, F.substring(F.col("markdown"), F.lit(1), at - 1)).otherwise(F.col("markdown"))
    notes = F.when(at > 0, F.substring(F.col("markdown"), at + len(NOTES), F.length("markdown")))
    staged = plans.where("markdown is not null").select(key, F.split(main, r"(?m)(?=^## Day \d+)").alias("s"), notes.alias("notes"))
    # A split by look-ahead leaves an empty first piece out if the text starts with a heading.
    pieces = F.when(F.get("s", F.lit(0)).rlike(r"^## Day \d+"), F.concat(F.array(F.lit("")), F.col("s"))).otherwise(F.col("s"))
    each = staged.select(key, F.posexplode(pieces).alias("position", "piece"))
    line = F.substring_index("piece", "\n", 1)
    rest = F.when(F.locate("\n", F.col("piece")) > 0, F.substring(F.col("piece"), F.length(line) + 2, F.length("piece"))).otherwise(F.lit(""))
    intro = each.where("position = 0").select(key, F.lit("intro").alias("part"), "position", F.lit(None).cast("string").alias("title"), strip(F.col("piece")).alias("body")).where("body <> ''")
    days = each.where("position > 0").select(key, F.lit("day").alias("part"), "position", strip(F.regexp_replace(line, "^## ", "")).alias("title"), strip(rest).alias("body"))
    tail = staged.where("notes is not null").select(key, F.lit("notes").alias("part"), F.lit(-1).alias("position"), F.lit("Practical notes").alias("title"), strip(F.col("notes")).alias("body"))
    return intro.unionByName(days).unionByName(tail)

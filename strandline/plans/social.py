"""The fourteen social reads, each one plan over all parameter rows.

``params`` has pid and what the read needs of: persons a and b, first_name, date (ms; 0: none), days,
country_x, country_y, tag, month, year and tag_class. ``knows`` is directed as stored; pass a
symmetric relation to treat it as such. Top-k lists are ranked per pid with ids as last keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import latency_minutes, message_content
from strandline.operators.traverse import all_shortest_paths, bounded_bfs, closure, hop, shortest_distance

Graph = dict[str, DataFrame]
DAY = 86_400_000


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(Window.partitionBy("pid").orderBy(*order))).where(f"_place <= {k}").drop("_place")


def friends(g: Graph, params: DataFrame) -> DataFrame:
    return hop(params.select("pid", F.col("a").alias("v")), g["knows"]).select("pid", F.col("other").alias("friend")).distinct()


def friends_and_foaf(g: Graph, params: DataFrame) -> DataFrame:
    _, seen = bounded_bfs(params.select("pid", F.col("a").alias("v")), [g["knows"]], None, 2)
    return seen.where("depth > 0").select("pid", F.col("v").alias("friend"))


def messages(g: Graph) -> DataFrame:
    posts = g["post"].select("id", "creator", "ts", "place", message_content("image", "content").alias("content"), F.lit(True).alias("is_post"))
    return posts.unionByName(g["comment"].select("id", "creator", "ts", "place", "content", F.lit(False).alias("is_post")))


def country_of_place(g: Graph) -> DataFrame:
    """(place, country): the first country up the partOf chain of at most 8 steps, else the place itself."""
    chain = closure(g["place"].where("part_of >= 0").select(F.col("id").alias("src"), F.col("part_of").alias("dst")), 8)
    countries = g["place"].where("type = 'country'").select(F.col("id").alias("upper"))
    first = chain.join(countries, "upper").groupBy("v").agg(F.min_by("upper", "steps").alias("country"))
    return g["place"].select(F.col("id").alias("v")).join(first, "v", "left").select(F.col("v").alias("place"), F.coalesce("country", "v").alias("country"))


def tag_closure(g: Graph) -> DataFrame:
    """(tag, tag_class): a tag's class and all classes above it."""
    chain = closure(g["tag_class"].where("subclass_of >= 0").select(F.col("id").alias("src"), F.col("subclass_of").alias("dst")))
    return g["tag"].select(F.col("id").alias("tag"), F.col("tag_class").alias("v")).join(chain, "v").select("tag", F.col("upper").alias("tag_class"))


def interaction_weights(g: Graph) -> DataFrame:
    """(x, y, weight) with x < y: 1 for each reply to a post, 0.5 to a comment, in either direction."""
    made = g["post"].select("id", F.col("creator").alias("to"), F.lit(1.0).alias("w")).unionByName(g["comment"].select("id", F.col("creator").alias("to"), F.lit(0.5).alias("w")))
    replies = g["comment"].select(F.col("creator").alias("by"), F.when(F.col("reply_of_post") >= 0, F.col("reply_of_post")).otherwise(F.col("reply_of_comment")).alias("id"))
    both = replies.join(made, "id").where("by <> to")
    return both.groupBy(F.least("by", "to").alias("x"), F.greatest("by", "to").alias("y")).agg(F.sum("w").alias("weight"))


def _person(g: Graph, *columns: str) -> DataFrame:
    return g["person"].select(F.col("id").alias("friend"), *columns)


def sq01(g: Graph, params: DataFrame) -> DataFrame:
    _, seen = bounded_bfs(params.select("pid", F.col("a").alias("v")), [g["knows"]], None, 3)
    named = seen.where("depth > 0").join(g["person"].withColumnRenamed("id", "v"), "v").join(params.select("pid", F.col("first_name").alias("wanted")), "pid").where("first_name = wanted")
    best = top(named.select("pid", F.col("v").alias("id"), "last_name", F.col("depth").alias("distance"), "gender", "birth_month", "birth_day", "place"), 20, "distance", "last_name", "id")
    places = g["place"].select(F.col("id").alias("place"), F.col("name").alias("city"))

    def served(name: str, table: str, year: str) -> DataFrame:
        org = g["organisation"].select(F.col("id").alias("organisation"), F.col("name").alias("org"))
        text = F.concat_ws(",", "org", F.col(year).cast("string"))
        return g[table].join(org, "organisation").groupBy(F.col("person").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias(name))

    out = best.join(places, "place", "left").join(served("universities", "study_at", "class_year"), "id", "left").join(served("companies", "work_at", "since"), "id", "left")
    return out.select("pid", "id", "last_name", "distance", "gender", "birth_month", "birth_day", *(F.coalesce(c, F.lit("")).alias(c) for c in ("city", "universities", "companies")))


def _recent(g: Graph, params: DataFrame, of: DataFrame) -> DataFrame:
    mine = of.join(messages(g).withColumnRenamed("creator", "friend"), "friend").join(params.select("pid", "date"), "pid").where("date = 0 or ts < date")
    best = top(mine, 20, F.desc("ts"), "id")
    return best.join(_person(g, "first_name", "last_name"), "friend").select("pid", "friend", "first_name", "last_name", F.col("id").alias("message"), "content", "ts")


def sq02(g: Graph, params: DataFrame) -> DataFrame:
    return _recent(g, params, friends(g, params))


def sq09(g: Graph, params: DataFrame) -> DataFrame:
    return _recent(g, params, friends_and_foaf(g, params))


def sq03(g: Graph, params: DataFrame) -> DataFrame:
    names = g["place"].where("type = 'country'").select(F.col("id").alias("country"), "name")
    where = params.select("pid", "date", "days", "country_x", "country_y")
    for c in "xy":
        where = where.join(names.select(F.col("country").alias(c), F.col("name").alias(f"country_{c}")), f"country_{c}")
    home = g["person"].select(F.col("id").alias("friend"), "place").join(country_of_place(g), "place").select("friend", F.col("country").alias("home"))
    strangers = friends_and_foaf(g, params).join(home, "friend").join(where, "pid").where("home <> x and home <> y")
    country = country_of_place(g)
    sent = messages(g).select(F.col("creator").alias("friend"), "ts", "place").join(country, "place")
    counts = strangers.join(sent, "friend").where(f"ts >= date and ts < date + days * {DAY}L").groupBy("pid", "friend").agg(F.count_if(F.col("country") == F.col("x")).alias("n_x"), F.count_if(F.col("country") == F.col("y")).alias("n_y"))
    best = top(counts.where("n_x > 0 and n_y > 0").withColumn("n", F.col("n_x") + F.col("n_y")), 20, F.desc("n"), "friend")
    return best.join(_person(g, "first_name", "last_name"), "friend").select("pid", "friend", "first_name", "last_name", "n_x", "n_y", "n")


def sq04(g: Graph, params: DataFrame) -> DataFrame:
    tagged = g["post"].select(F.col("id").alias("message"), F.col("creator").alias("friend"), "ts").join(g["post_tag"], "message")
    used = friends(g, params).join(tagged, "friend").join(params.select("pid", "date", "days"), "pid")
    before = used.where("ts < date").select("pid", "tag").distinct()
    new = used.where(f"ts >= date and ts < date + days * {DAY}L").groupBy("pid", "tag").agg(F.count("*").alias("n")).join(before, ["pid", "tag"], "left_anti")
    named = new.join(g["tag"].select(F.col("id").alias("tag"), "name"), "tag").select("pid", "name", "n")
    return top(named, 10, F.desc("n"), "name")


def sq05(g: Graph, params: DataFrame) -> DataFrame:
    people = friends_and_foaf(g, params).join(params.select("pid", "date"), "pid")
    joined = people.join(g["member"].withColumnRenamed("person", "friend"), "friend").where("joined > date").select("pid", "friend", "forum").distinct()
    posts = g["post"].select(F.col("creator").alias("friend"), "forum")
    counts = joined.join(posts, ["friend", "forum"]).groupBy("pid", "forum").agg(F.count("*").alias("n"))
    return top(counts, 20, F.desc("n"), "forum").join(g["forum"].withColumnRenamed("id", "forum"), "forum").select("pid", "forum", "title", "n")


def sq06(g: Graph, params: DataFrame) -> DataFrame:
    tags = g["tag"].select(F.col("id").alias("tag"), "name")
    wanted = params.select("pid", F.col("tag").alias("name")).join(tags, "name").select("pid", F.col("tag").alias("wanted"))
    posts = g["post"].select(F.col("id").alias("message"), F.col("creator").alias("friend"))
    mine = friends_and_foaf(g, params).join(posts, "friend").join(wanted, "pid")
    holds = mine.join(g["post_tag"].select("message", F.col("tag").alias("wanted")), ["message", "wanted"], "left_semi")
    others = holds.join(g["post_tag"], "message").where("tag <> wanted").groupBy("pid", "tag").agg(F.count("*").alias("n"))
    return top(others.join(tags, "tag").select("pid", "name", "n"), 10, F.desc("n"), "name")


def sq07(g: Graph, params: DataFrame) -> DataFrame:
    own = params.select("pid", F.col("a").alias("creator")).join(messages(g), "creator").select("pid", F.col("id").alias("message"), "content", F.col("ts").alias("made"))
    liked = own.join(g["likes"], "message")
    latest = liked.groupBy("pid", F.col("person").alias("friend")).agg(F.max_by(F.struct("message", "content", "made", "ts"), F.struct("ts", -F.col("message"))).alias("l")).select("pid", "friend", "l.*")
    best = top(latest, 20, F.desc("ts"), "friend")
    known = friends(g, params).withColumn("known", F.lit(True))
    out = best.join(_person(g, "first_name", "last_name"), "friend").join(known, ["pid", "friend"], "left")
    return out.select("pid", "friend", "first_name", "last_name", "ts", "message", "content", latency_minutes("ts", "made").alias("minutes"), F.col("known").isNull().alias("is_new"))


def sq08(g: Graph, params: DataFrame) -> DataFrame:
    own = params.select("pid", F.col("a").alias("creator")).join(messages(g).select("creator", F.col("id").alias("message")), "creator").select("pid", "message")
    replies = g["comment"].select(F.when(F.col("reply_of_post") >= 0, F.col("reply_of_post")).otherwise(F.col("reply_of_comment")).alias("message"), F.col("creator").alias("friend"), "ts", F.col("id").alias("comment"), "content")
    best = top(own.join(replies, "message"), 20, F.desc("ts"), "comment")
    return best.join(_person(g, "first_name", "last_name"), "friend").select("pid", "friend", "first_name", "last_name", "ts", "comment", "content")


def sq10(g: Graph, params: DataFrame) -> DataFrame:
    near = friends_and_foaf(g, params).join(friends(g, params), ["pid", "friend"], "left_anti")
    people = near.join(_person(g, "first_name", "last_name", "gender", "birth_month", "birth_day", "place"), "friend").join(params.select("pid", "a", "month"), "pid")
    born = people.where("(birth_month = month and birth_day >= 21) or (birth_month = month % 12 + 1 and birth_day < 22)")
    liked = born.select("pid", "a").distinct().join(g["interest"].withColumnRenamed("person", "a"), "a").join(g["post_tag"], "tag").select("pid", "message").distinct().withColumn("common", F.lit(1))
    posts = born.select("pid", "friend").join(g["post"].select(F.col("creator").alias("friend"), F.col("id").alias("message")), "friend").join(liked, ["pid", "message"], "left")
    scores = posts.groupBy("pid", "friend").agg(F.sum(F.when(F.col("common") == 1, 1).otherwise(-1)).alias("score"))
    out = born.join(scores, ["pid", "friend"], "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("long"))
    best = top(out, 10, F.desc("score"), "friend")
    return best.join(g["place"].select(F.col("id").alias("place"), F.col("name").alias("city")), "place", "left").select("pid", "friend", "first_name", "last_name", "score", "gender", F.coalesce("city", F.lit("")).alias("city"))


def sq11(g: Graph, params: DataFrame) -> DataFrame:
    country = g["place"].where("type = 'country'").select(F.col("name").alias("country_x"), F.col("id").alias("place"))
    firms = g["organisation"].where("type = 'company'").select(F.col("id").alias("organisation"), F.col("name").alias("company"), "place").join(country, "place")
    jobs = friends_and_foaf(g, params).join(g["work_at"].withColumnRenamed("person", "friend"), "friend").join(firms, "organisation").join(params.select("pid", "country_x", "year"), ["pid", "country_x"]).where("since < year")
    best = top(jobs, 10, "since", "friend", F.desc("company"))
    return best.join(_person(g, "first_name", "last_name"), "friend").select("pid", "friend", "first_name", "last_name", "company", "since")


def sq12(g: Graph, params: DataFrame) -> DataFrame:
    classes = g["tag_class"].select(F.col("id").alias("class_id"), F.col("name").alias("tag_class"))
    wanted = params.select("pid", "tag_class").join(classes, "tag_class").join(tag_closure(g).withColumnRenamed("tag_class", "class_id"), "class_id").select("pid", "tag")
    replies = g["comment"].where("reply_of_post >= 0").select(F.col("creator").alias("friend"), F.col("id").alias("comment"), F.col("reply_of_post").alias("message"))
    found = friends(g, params).join(replies, "friend").join(g["post_tag"], "message").join(wanted, ["pid", "tag"]).join(g["tag"].select(F.col("id").alias("tag"), "name"), "tag")
    counts = found.groupBy("pid", "friend").agg(F.array_join(F.array_sort(F.collect_set("name")), ";").alias("tags"), F.countDistinct("comment").alias("replies"))
    return top(counts, 20, F.desc("replies"), "friend").join(_person(g, "first_name", "last_name"), "friend").select("pid", "friend", "first_name", "last_name", "tags", "replies")


def sq13(g: Graph, params: DataFrame) -> DataFrame:
    return shortest_distance(params.select("pid", "a", "b"), g["knows"])


def sq14(g: Graph, params: DataFrame) -> DataFrame:
    paths = all_shortest_paths(params.select("pid", "a", "b"), g["knows"])
    steps = paths.select("pid", "path", F.posexplode("path").alias("k", "x")).where("k + 1 < size(path)").select("pid", "path", F.col("x").alias("p"), F.get("path", F.col("k") + 1).alias("q"))
    steps = steps.select("pid", "path", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).join(interaction_weights(g), ["x", "y"], "left")
    sums = steps.groupBy("pid", "path").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    out = paths.join(sums, ["pid", "path"], "left")
    return out.select("pid", F.array_join(F.col("path").cast("array<string>"), ";").alias("path"), F.format_string("%.1f", F.coalesce("weight", F.lit(0.0))).alias("weight"))


MESSAGES = ("post", "comment")
READS = {
    "sq01": (sq01, ("knows", "person", "place", "organisation", "study_at", "work_at")),
    "sq02": (sq02, ("knows", "person", *MESSAGES)),
    "sq03": (sq03, ("knows", "person", "place", *MESSAGES)),
    "sq04": (sq04, ("knows", "post", "post_tag", "tag")),
    "sq05": (sq05, ("knows", "member", "post", "forum")),
    "sq06": (sq06, ("knows", "post", "post_tag", "tag")),
    "sq07": (sq07, ("knows", "person", "likes", *MESSAGES)),
    "sq08": (sq08, ("person", *MESSAGES)),
    "sq09": (sq09, ("knows", "person", *MESSAGES)),
    "sq10": (sq10, ("knows", "person", "place", "interest", "post", "post_tag")),
    "sq11": (sq11, ("knows", "person", "place", "organisation", "work_at")),
    "sq12": (sq12, ("knows", "person", "tag", "tag_class", "post_tag", "comment")),
    "sq13": (sq13, ("knows",)),
    "sq14": (sq14, ("knows", *MESSAGES)),
}

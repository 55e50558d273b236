"""The writes of both workloads as rows: what a record creates, in nodes and edges, and how these reach a graph.

Nodes are (kind, raw_id, at, properties) and edges (relation, src_kind, src, dst_kind, dst, at, properties), with raw
ids as text, ``at`` in milliseconds and properties as a map from names to text. Every record kind is a projection
of its columns; lists in a record are exploded. Raw ids become vertices by a join with the table of ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import edge_weight, length_bucket, split_list, split_pairs, time_millis, to_uint
from strandline.sources.shared import materialise, numbered
from strandline.store import Graph

NODE = "kind string, raw_id string, at long, properties map<string,string>"

# ---------------------------------------------------------------- fixed values

#: Relations of the financial graph: type, source and target kind, their columns, properties.
FINANCIAL = {
    "AccountTransferAccount": (1, "Account", "Account", "fromId", "toId", ["createTime", "amount", "orderNum", "comment", "payType", "goodsType", "dependencyTime"]),
    "AccountWithdrawAccount": (3, "Account", "Account", "fromId", "toId", ["createTime", "amount", "fromType", "toType", "comment", "dependencyTime"]),
    "AccountRepayLoan": (5, "Account", "Loan", "accountId", "loanId", ["createTime", "amount", "comment", "dependencyTime"]),
    "CompanyApplyLoan": (7, "Company", "Loan", "companyId", "loanId", ["createTime", "loanAmount", "org", "comment"]),
    "CompanyGuaranteeCompany": (9, "Company", "Company", "fromId", "toId", ["createTime", "relation", "comment"]),
    "CompanyInvestCompany": (11, "Company", "Company", "investorId", "companyId", ["ratio", "createTime", "comment"]),
    "CompanyOwnAccount": (13, "Company", "Account", "companyId", "accountId", ["createTime", "comment"]),
    "LoanDepositAccount": (15, "Loan", "Account", "loanId", "accountId", ["createTime", "amount", "comment", "dependencyTime"]),
    "MediumSignInAccount": (17, "Medium", "Account", "mediumId", "accountId", ["createTime", "location", "comment", "dependencyTime"]),
    "PersonApplyLoan": (19, "Person", "Loan", "personId", "loanId", ["createTime", "loanAmount", "org", "comment"]),
    "PersonGuaranteePerson": (21, "Person", "Person", "fromId", "toId", ["createTime", "relation", "comment"]),
    "PersonInvestCompany": (23, "Person", "Company", "investorId", "companyId", ["ratio", "createTime", "comment"]),
    "PersonOwnAccount": (25, "Person", "Account", "personId", "accountId", ["createTime", "comment"]),
}
#: Incremental writes by number: the kind of node that a record adds, with its id column and property columns.
ACCOUNT = ("Account", "accountId", {n: n for n in ("accountType", "nickname", "phonenum", "email", "freqLoginType", "lastLoginTime", "accountLevel")} | {"isBlocked": "accountBlocked"})
LOAN = ("Loan", "loanId", {n: n for n in ("loanAmount", "balance", "loanUsage", "interestRate")})
NODE_WRITES = {
    1: ("Person", "personId", {n: n for n in ("createTime", "personName", "isBlocked", "gender", "birthday", "country", "city")}),
    2: ("Company", "companyId", {n: n for n in ("createTime", "companyName", "isBlocked", "country", "city", "business", "description", "url")}),
    3: ("Medium", "mediumId", {n: n for n in ("createTime", "mediumType", "isBlocked", "lastLoginTime", "riskLevel")}),
    4: ACCOUNT, 5: ACCOUNT, 6: LOAN, 7: LOAN,
}
#: The relation of the edge that a record adds.
EDGE_WRITES = {
    4: "PersonOwnAccount", 5: "CompanyOwnAccount", 6: "PersonApplyLoan", 7: "CompanyApplyLoan", 8: "PersonInvestCompany",
    9: "CompanyInvestCompany", 10: "PersonGuaranteePerson", 11: "CompanyGuaranteeCompany", 12: "AccountTransferAccount",
    13: "AccountWithdrawAccount", 14: "AccountRepayLoan", 15: "LoanDepositAccount", 16: "MediumSignInAccount",
}
TIME_LIKE = {"createTime", "dependencyTime", "lastLoginTime", "deleteTime", "dependentDate"}
#: Edge types of the social graph that updates write: type, source and target kind.
SOCIAL = {
    "knows": (1, "Person", "Person"), "hasMember": (2, "Forum", "Person"), "forumHasTag": (3, "Forum", "Tag"), "hasInterest": (4, "Person", "Tag"),
    "likesPost": (5, "Person", "Post"), "likesComment": (6, "Person", "Comment"), "studyAt": (7, "Person", "Organisation"), "workAt": (8, "Person", "Organisation"),
    "postHasTag": (9, "Post", "Tag"), "commentHasTag": (10, "Comment", "Tag"), "postCreator": (11, "Post", "Person"), "postContainer": (12, "Post", "Forum"),
    "postLocation": (13, "Post", "Place"), "commentCreator": (14, "Comment", "Person"), "commentLocation": (15, "Comment", "Place"),
    "replyOfPost": (16, "Comment", "Post"), "replyOfComment": (17, "Comment", "Comment"), "moderator": (22, "Forum", "Person"), "personLocation": (23, "Person", "Place"),
}
#: Node records of the social update stream, by operation: kind and the places of the properties; the id is at 3.
SOCIAL_NODES = {
    "1": ("Person", {"firstName": 4, "lastName": 5, "gender": 6, "birthday": 7, "creationDate": 8, "locationIP": 9, "browserUsed": 10, "place": 11, "language": 12, "email": 13}),
    "4": ("Forum", {"title": 4, "creationDate": 5}),
    "6": ("Post", {"imageFile": 4, "creationDate": 5, "locationIP": 6, "browserUsed": 7, "language": 8, "content": 9, "length": 10, "place": 13}),
    "7": ("Comment", {"creationDate": 4, "locationIP": 5, "browserUsed": 6, "content": 7, "length": 8, "place": 10}),
}
#: Properties that records of likes, memberships and knows may bring along, from place 6 on.
WIDE = ["edgeTypeCode", "eventMonth", "eventDow", "srcCountryId", "srcCityId", "dstCountryId", "dstCityId", "srcActivityBucket", "dstActivityBucket"]
WIDE_LIKES, WIDE_MEMBER, WIDE_KNOWS = [*WIDE, "edgeWeight", "messageLengthBucket"], [*WIDE, "sameCountry", "sameCity"], [*WIDE, "edgeWeight", "interactionCnt", "sameCountry", "sameCity"]

# ---------------------------------------------------------------- records to nodes and edges


def _map(values: dict[str, Column]) -> Column:
    """The properties that have a value; empty text and -1 are none."""
    entries = F.array(*(F.struct(F.lit(n).alias("key"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for n, v in values.items()))
    return F.map_from_entries(F.filter(entries, lambda e: (e["value"] != "") & (e["value"] != "-1")))


def normalised(name: str, value: Column) -> Column:
    """Times as milliseconds, all else as it is; empty stays empty."""
    return F.when(value == "", value).otherwise(time_millis(value).cast("string")) if name in TIME_LIKE else value


def financial_writes(rows: DataFrame, write: int) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that the records of an incremental write (1 to 16) add; missing columns are empty.

    Repayments name the account ``account``. An account or loan that a record brings is a new version of it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    at = time_millis(text("createTime")).alias("at")
    nodes, edges = rows.sparkSession.createDataFrame([], NODE), None
    if write in NODE_WRITES:
        kind, key, columns = NODE_WRITES[write]
        nodes = rows.select(F.lit(kind).alias("kind"), text(key).alias("raw_id"), at, _map({n: normalised(n, text(c)) for n, c in columns.items()}).alias("properties"))
    if write in EDGE_WRITES:
        name = EDGE_WRITES[write]
        _, src_kind, dst_kind, src, dst, columns = FINANCIAL[name]
        edges = _edges(rows.select(at, text("account" if write == 14 else src).alias("src"), text(dst).alias("dst"), _map({n: normalised(n, text(n)) for n in columns}).alias("properties")), name, src_kind, dst_kind)
    return nodes, edges if edges is not None else _edges(rows.sparkSession.createDataFrame([], "src string, dst string, at long, properties map<string,string>"), "", "", "")


def _edges(df: DataFrame, relation: str, src_kind: str, dst_kind: str) -> DataFrame:
    return df.select(F.lit(relation).alias("relation"), F.lit(src_kind).alias("src_kind"), "src", F.lit(dst_kind).alias("dst_kind"), "dst", "at", "properties")


def social_writes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of update lines (value): time|dependency|operation 1 to 8|fields; lines without an id are left out.

    One pass over the lines: each makes an array of its edges, which is exploded."""
    rows = lines.select(F.split("value", r"\|", -1).alias("f")).select("f", F.get("f", F.lit(2)).alias("op"), to_uint(F.get("f", F.lit(0))).alias("at"))
    at = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    rows = rows.where(at(3) != "")
    kind, properties = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for op, (k, places) in SOCIAL_NODES.items():
        kind = F.when(F.col("op") == op, k).otherwise(kind)
        properties = F.when(F.col("op") == op, _map({n: at(i) for n, i in places.items()})).otherwise(properties)
    nodes = rows.select(kind.alias("kind"), at(3).alias("raw_id"), "at", properties.alias("properties")).where("kind is not null")

    def edge(relation: str, dst: Column, more: dict[str, Column], src: Column = at(3)) -> Column:
        _, a, b = SOCIAL[relation]
        return F.struct(F.lit(relation).alias("relation"), F.lit(a).alias("src_kind"), src.alias("src"), F.lit(b).alias("dst_kind"), dst.alias("dst"), _map({"edgeExists": F.lit("1"), **more}).alias("properties"))

    def wide(names: list[str]) -> dict[str, Column]:
        enough = F.size("f") >= 6 + len(names)
        return {n: F.when(enough, at(6 + i)) for i, n in enumerate(names)}

    def message(tags: str, given: int, length: int, tag_list: int) -> tuple[Column, Column]:
        bucket = F.when(at(given) != "", at(given)).otherwise(length_bucket(to_uint(at(length))).cast("string"))
        return bucket, F.transform(split_list(at(tag_list)), lambda t: edge(tags, t, {"messageLengthBucket": bucket}))

    post_bucket, post_tags = message("postHasTag", 15, 10, 14)
    bucket, comment_tags = message("commentHasTag", 14, 8, 13)
    made, said = {"creationDate": at(5)}, {"creationDate": at(4)}
    person = F.concat(
        F.array(edge("personLocation", at(11), {})),
        F.transform(split_list(at(14)), lambda t: edge("hasInterest", t, {"edgeWeight": edge_weight(to_uint(at(3)), to_uint(t))})),
        F.transform(split_pairs(at(15)), lambda p: edge("studyAt", p["id"], {"classYear": p["val"]})),
        F.transform(split_pairs(at(16)), lambda p: edge("workAt", p["id"], {"workFrom": p["val"]})),
    )
    of_op = {
        "1": person,
        "2": F.array(edge("likesPost", at(4), made | wide(WIDE_LIKES))),
        "3": F.array(edge("likesComment", at(4), made | wide(WIDE_LIKES))),
        "4": F.concat(F.array(edge("moderator", at(6), made)), F.transform(split_list(at(7)), lambda t: edge("forumHasTag", t, {"srcActivityBucket": at(8)}))),
        "5": F.array(edge("hasMember", at(4), {"joinDate": at(5)} | wide(WIDE_MEMBER))),
        "6": F.concat(F.array(edge("postCreator", at(11), made), edge("postContainer", at(12), made), edge("postLocation", at(13), made)), post_tags),
        "7": F.concat(F.array(edge("commentCreator", at(9), said), edge("commentLocation", at(10), said), edge("replyOfPost", at(11), said | {"messageLengthBucket": bucket}), edge("replyOfComment", at(12), said | {"messageLengthBucket": bucket})), comment_tags),
        "8": F.array(edge("knows", at(4), made | wide(WIDE_KNOWS))),
    }
    parts = [rows.where(F.col("op") == op).select("at", F.explode(e).alias("e")) for op, e in of_op.items()]
    edges = reduce(DataFrame.unionByName, parts).select("e.relation", "e.src_kind", "e.src", "e.dst_kind", "e.dst", "at", "e.properties")
    return nodes, edges.where("dst not in ('', '-1')")


# ---------------------------------------------------------------- raw ids, stubs, reads


def stubs(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes without properties for the ends (kind, raw_id) of edges that neither ``known`` nor ``nodes`` has."""
    ends = edges.select(F.col("src_kind").alias("kind"), F.col("src").alias("raw_id"), "at").unionByName(edges.select(F.col("dst_kind").alias("kind"), F.col("dst").alias("raw_id"), "at"))
    ends = ends.groupBy("kind", "raw_id").agg(F.min("at").alias("at"))
    new = ends.join(known.select("kind", "raw_id").unionByName(nodes.select("kind", "raw_id")).distinct(), ["kind", "raw_id"], "left_anti")
    return new.select("kind", "raw_id", "at", F.create_map().cast("map<string,string>").alias("properties"))


def vertex_ids(nodes: DataFrame, first: int = 1) -> DataFrame:
    """(kind, raw_id, vid): dense numbers of the different nodes."""
    return numbered(nodes.select("kind", "raw_id").distinct(), first, "vid")


def import_writes(graph: Graph, nodes: DataFrame, edges: DataFrame, ids: DataFrame, types: dict[str, int]) -> DataFrame:
    """Put nodes and edges into a graph under their vertices; the edges with an end that has none, which are left out.

    ``types`` maps relations to edge types. Properties that the schema does not have are not kept."""
    rows = nodes.join(ids, ["kind", "raw_id"]).withColumn("properties", F.map_concat("properties", F.create_map(F.lit("rawId"), F.col("raw_id"))))
    graph.put_nodes(rows.select("vid", *(F.col("properties")[n].alias(n) for n in graph.schema.node.properties)))
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("kind").alias(f"{end}_kind"), F.col("raw_id").alias(end), F.col("vid").alias(f"{end}_vid")), [f"{end}_kind", end], "left")
    edges = materialise(edges)
    both = F.col("src_vid").isNotNull() & F.col("dst_vid").isNotNull()
    code = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))[F.col("relation")]
    names = [p for g in graph.schema.groups for p in g.properties]
    graph.put_edges(edges.where(both).select(F.col("src_vid").alias("src"), F.col("dst_vid").alias("dst"), code.alias("edge_type"), *(F.col("properties")[n].alias(n) for n in names)))
    return edges.where(~both).drop("src_vid", "dst_vid")


def node_reads(asked: DataFrame, nodes: DataFrame, *names: str) -> DataFrame:
    """Every request (vid) with the named properties of its node's newest row, null if there is none."""
    newest = nodes.groupBy("vid").agg(F.max_by(F.struct("seq", *names), "seq").alias("r")).select("vid", "r.*")
    return asked.join(newest, "vid", "left")


def first_match(edges: DataFrame) -> DataFrame:
    """(src, dst, seq): of each source the edge to the smallest target, its newest version."""
    best = edges.groupBy("src").agg(F.min(F.struct("dst", (-F.col("seq")).alias("back"))).alias("b"))
    return best.select("src", "b.dst", (-F.col("b.back")).alias("seq"))


def checksum(df: DataFrame, place: str | None = None) -> DataFrame:
    """(rows, checksum): the rows' hashes by exclusive or; with ``place``, the column of their order takes part."""
    columns = [F.col(c).cast("string") for c in sorted(df.columns) if c != place]
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*columns, *([F.col(place)] if place else []))), F.lit(0).cast("long")).alias("checksum"))

"""The social reads in SQL, over the parameter rows of the catalogue."""

from __future__ import annotations

from strandline.plans.sql import query, values

COLUMNS = ["pid", "a", "b", "first_name", "date", "days", "country_x", "country_y", "tag", "month", "year", "tag_class"]
PARAMS = [
    (1, 10, 77, "BUILDING", 892000000000, 400, "NATION_15", "NATION_4", "NATION_7", 5, 2012, "AFRICA"),
    (2, 21, 98, "MACHINERY", 789500000000, 40, "NATION_16", "NATION_2", "NATION_1", 12, 2000, "ASIA"),
    (3, 3, 3, "HOUSEHOLD", 0, 3000, "NATION_7", "NATION_0", "NATION_9", 1, 2015, "AMERICA"),
    (4, 140, 7, "FURNITURE", 884000000000, 900, "NATION_12", "NATION_20", "NATION_16", 7, 2020, "EUROPE"),
    (5, 999999, 4, "BUILDING", 884000000000, 900, "NATION_12", "NATION_20", "NATION_16", 7, 2020, "EUROPE"),
]
DAY = 86_400_000

BASE = {
    "friends": "friends AS (SELECT DISTINCT pid, dst AS friend FROM params JOIN knows ON src = a)",
    "foaf": "foaf AS (SELECT f.pid, f.friend FROM (SELECT pid, friend FROM friends UNION SELECT f.pid, k.dst FROM friends f JOIN knows k ON k.src = f.friend) f JOIN params p ON p.pid = f.pid WHERE f.friend <> p.a)",
    "message": """message AS (SELECT id, creator, ts, place, CASE WHEN image <> '' THEN image ELSE content END AS content FROM post
  UNION ALL SELECT id, creator, ts, place, content FROM comment)""",
    "reply": "reply AS (SELECT id AS comment, creator AS friend, ts, content, CASE WHEN reply_of_post >= 0 THEN reply_of_post ELSE reply_of_comment END AS message FROM comment)",
    "class_of": """class_of(tag, tag_class) AS (SELECT id, tag_class FROM tag UNION
  SELECT c.tag, t.subclass_of FROM class_of c JOIN tag_class t ON t.id = c.tag_class WHERE t.subclass_of >= 0)""",
    "chain": "chain(v, upper, steps) AS (SELECT id, id, 0 FROM place UNION ALL SELECT c.v, p.part_of, c.steps + 1 FROM chain c JOIN place p ON p.id = c.upper WHERE p.part_of >= 0 AND c.steps < 8)",
    "country_of": "country_of AS (SELECT v AS place, coalesce(arg_min(upper, steps) FILTER (WHERE upper IN (SELECT id FROM place WHERE type = 'country')), v) AS country FROM chain GROUP BY v)",
    "weights": """weights AS (SELECT least(c.creator, m.creator) AS x, greatest(c.creator, m.creator) AS y, sum(m.w) AS weight FROM comment c
  JOIN (SELECT id, creator, 1.0::DOUBLE AS w FROM post UNION ALL SELECT id, creator, 0.5::DOUBLE FROM comment) m
  ON m.id = CASE WHEN c.reply_of_post >= 0 THEN c.reply_of_post ELSE c.reply_of_comment END WHERE c.creator <> m.creator GROUP BY 1, 2)""",
    "reach": "reach(pid, v, d) AS (SELECT pid, a, 0 FROM params UNION SELECT r.pid, k.dst, r.d + 1 FROM reach r JOIN knows k ON k.src = r.v WHERE r.d < 12)",
    "nearest": "nearest AS (SELECT pid, v, CAST(min(d) AS INTEGER) AS depth FROM reach GROUP BY pid, v)",
}


def _q(base: list[str], select: str, extra: tuple[str, ...] = ()) -> str:
    return query(values("params", COLUMNS, PARAMS), [*(BASE[b] for b in base), *extra], select, recursive=bool({"class_of", "chain", "reach"} & set(base)) or any("_r(" in e for e in extra))


def _top(k: int, order: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY pid ORDER BY {order}) <= {k}"


def _recent(of: str) -> str:
    return f"""SELECT f.pid, f.friend, first_name, last_name, id AS message, content, ts FROM (
  SELECT f.pid, f.friend, m.id, m.content, m.ts FROM {of} f JOIN params p ON p.pid = f.pid JOIN message m ON m.creator = f.friend
  WHERE p.date = 0 OR m.ts < p.date QUALIFY row_number() OVER (PARTITION BY f.pid ORDER BY m.ts DESC, m.id) <= 20) f
  JOIN (SELECT id AS person, first_name, last_name FROM person) ON person = f.friend"""


WINDOW = f"ts >= p.date AND ts < p.date + p.days * {DAY}::BIGINT"
SQL = {
    "sq01": _q(
        ["reach", "nearest"],
        f"""SELECT pid, id, last_name, distance, gender, birth_month, birth_day, coalesce((SELECT name FROM place WHERE place.id = t.place), '') AS city,
  coalesce((SELECT string_agg(concat(o.name, ',', class_year), ';' ORDER BY concat(o.name, ',', class_year)) FROM study_at JOIN organisation o ON o.id = organisation WHERE person = t.id), '') AS universities,
  coalesce((SELECT string_agg(concat(o.name, ',', since), ';' ORDER BY concat(o.name, ',', since)) FROM work_at JOIN organisation o ON o.id = organisation WHERE person = t.id), '') AS companies
FROM (SELECT n.pid, person.id, last_name, n.depth AS distance, gender, birth_month, birth_day, place FROM nearest n JOIN params p ON p.pid = n.pid
  JOIN person ON person.id = n.v AND person.first_name = p.first_name WHERE n.depth BETWEEN 1 AND 3
  QUALIFY row_number() OVER (PARTITION BY n.pid ORDER BY n.depth, last_name, person.id) <= 20) t""",
    ),
    "sq02": _q(["friends", "message"], _recent("friends")),
    "sq09": _q(["friends", "foaf", "message"], _recent("foaf")),
    "sq03": _q(
        ["friends", "foaf", "message", "chain", "country_of"],
        f"""SELECT t.pid, t.friend, first_name, last_name, n_x, n_y, n_x + n_y AS n FROM (
  SELECT f.pid, f.friend, count(*) FILTER (WHERE c.country = x.id) AS n_x, count(*) FILTER (WHERE c.country = y.id) AS n_y
  FROM foaf f JOIN params p ON p.pid = f.pid JOIN place x ON x.name = p.country_x AND x.type = 'country' JOIN place y ON y.name = p.country_y AND y.type = 'country'
  JOIN person h ON h.id = f.friend JOIN country_of hc ON hc.place = h.place JOIN message m ON m.creator = f.friend JOIN country_of c ON c.place = m.place
  WHERE hc.country <> x.id AND hc.country <> y.id AND m.{WINDOW.replace(" ts <", " m.ts <")} GROUP BY f.pid, f.friend) t JOIN person ON person.id = t.friend
WHERE n_x > 0 AND n_y > 0 {_top(20, "n_x + n_y DESC, t.friend").replace("BY pid", "BY t.pid")}""",
    ),
    "sq04": _q(
        ["friends"],
        f"""SELECT pid, name, n FROM (SELECT u.pid, tag.name, u.n FROM (
  SELECT pid, tag, count(*) FILTER (WHERE inside) AS n FROM used GROUP BY pid, tag HAVING count(*) FILTER (WHERE inside) > 0 AND count(*) FILTER (WHERE early) = 0) u
  JOIN tag ON tag.id = u.tag) {_top(10, "n DESC, name")}""",
        (f"used AS (SELECT f.pid, t.tag, {WINDOW} AS inside, ts < p.date AS early FROM friends f JOIN params p ON p.pid = f.pid JOIN post ON post.creator = f.friend JOIN post_tag t ON t.message = post.id)",),
    ),
    "sq05": _q(
        ["friends", "foaf"],
        f"""SELECT c.pid, c.forum, title, n FROM (SELECT j.pid, j.forum, count(*) AS n FROM (
  SELECT DISTINCT f.pid, f.friend, m.forum FROM foaf f JOIN params p ON p.pid = f.pid JOIN member m ON m.person = f.friend WHERE m.joined > p.date) j
  JOIN post ON post.creator = j.friend AND post.forum = j.forum GROUP BY j.pid, j.forum {_top(20, "count(*) DESC, forum").replace("BY pid", "BY j.pid").replace(", forum", ", j.forum")}) c JOIN forum ON forum.id = c.forum""",
    ),
    "sq06": _q(
        ["friends", "foaf"],
        f"""SELECT pid, name, n FROM (SELECT f.pid, o.name, count(*) AS n FROM foaf f JOIN params p ON p.pid = f.pid JOIN tag w ON w.name = p.tag
  JOIN post ON post.creator = f.friend JOIN post_tag a ON a.message = post.id AND a.tag = w.id JOIN post_tag b ON b.message = post.id AND b.tag <> w.id
  JOIN tag o ON o.id = b.tag GROUP BY f.pid, o.name) {_top(10, "n DESC, name")}""",
    ),
    "sq07": _q(
        ["friends", "message"],
        f"""SELECT t.pid, t.friend, first_name, last_name, t.ts, t.message, t.content, (t.ts - t.made) // 60000 * (CASE WHEN t.ts >= t.made THEN 1 ELSE 0 END)
    - (t.made - t.ts) // 60000 * (CASE WHEN t.ts < t.made THEN 1 ELSE 0 END) AS minutes,
  NOT EXISTS (SELECT 1 FROM friends f WHERE f.pid = t.pid AND f.friend = t.friend) AS is_new
FROM (SELECT * FROM (SELECT p.pid, l.person AS friend, l.ts, m.id AS message, m.content, m.ts AS made FROM params p JOIN message m ON m.creator = p.a JOIN likes l ON l.message = m.id
  QUALIFY row_number() OVER (PARTITION BY p.pid, l.person ORDER BY l.ts DESC, m.id) = 1) {_top(20, "ts DESC, friend")}) t JOIN person ON person.id = t.friend""",
    ),
    "sq08": _q(
        ["message", "reply"],
        f"""SELECT t.pid, t.friend, first_name, last_name, t.ts, t.comment, t.content FROM (SELECT * FROM (
  SELECT p.pid, r.friend, r.ts, r.comment, r.content FROM params p JOIN message m ON m.creator = p.a JOIN reply r ON r.message = m.id) {_top(20, "ts DESC, comment")}) t JOIN person ON person.id = t.friend""",
    ),
    "sq10": _q(
        ["friends", "foaf"],
        f"""SELECT pid, friend, first_name, last_name, score, gender, coalesce((SELECT name FROM place WHERE place.id = t.place), '') AS city FROM (
  SELECT f.pid, f.friend, h.first_name, h.last_name, h.gender, h.place, CAST(coalesce((SELECT sum(CASE WHEN EXISTS (
      SELECT 1 FROM post_tag g JOIN interest i ON i.tag = g.tag WHERE g.message = post.id AND i.person = p.a) THEN 1 ELSE -1 END) FROM post WHERE post.creator = f.friend), 0) AS BIGINT) AS score
  FROM foaf f JOIN params p ON p.pid = f.pid JOIN person h ON h.id = f.friend
  WHERE NOT EXISTS (SELECT 1 FROM friends d WHERE d.pid = f.pid AND d.friend = f.friend)
    AND ((h.birth_month = p.month AND h.birth_day >= 21) OR (h.birth_month = p.month % 12 + 1 AND h.birth_day < 22))) t {_top(10, "score DESC, friend")}""",
    ),
    "sq11": _q(
        ["friends", "foaf"],
        f"""SELECT pid, friend, first_name, last_name, company, since FROM (SELECT f.pid, f.friend, h.first_name, h.last_name, o.name AS company, w.since
  FROM foaf f JOIN params p ON p.pid = f.pid JOIN work_at w ON w.person = f.friend JOIN organisation o ON o.id = w.organisation AND o.type = 'company'
  JOIN place c ON c.id = o.place AND c.type = 'country' AND c.name = p.country_x JOIN person h ON h.id = f.friend WHERE w.since < p.year) {_top(10, "since, friend, company DESC")}""",
    ),
    "sq12": _q(
        ["friends", "class_of"],
        f"""SELECT t.pid, t.friend, first_name, last_name, tags, replies FROM (SELECT * FROM (
  SELECT f.pid, f.friend, string_agg(DISTINCT tag.name, ';' ORDER BY tag.name) AS tags, count(DISTINCT c.id) AS replies
  FROM friends f JOIN params p ON p.pid = f.pid JOIN comment c ON c.creator = f.friend AND c.reply_of_post >= 0 JOIN post_tag g ON g.message = c.reply_of_post
  JOIN class_of o ON o.tag = g.tag JOIN tag_class k ON k.id = o.tag_class AND k.name = p.tag_class JOIN tag ON tag.id = g.tag GROUP BY f.pid, f.friend) {_top(20, "replies DESC, friend")}) t
JOIN person ON person.id = t.friend""",
    ),
    "sq13": _q(["reach", "nearest"], "SELECT p.pid, coalesce(n.depth, -1) AS distance FROM params p LEFT JOIN nearest n ON n.pid = p.pid AND n.v = p.b"),
    "sq14": _q(
        ["reach", "nearest", "weights"],
        """SELECT p.pid, array_to_string(path, ';') AS path, printf('%.1f', coalesce((SELECT sum(w.weight) FROM (SELECT unnest(range(1, len(p.path))) AS k) s
  JOIN weights w ON w.x = least(p.path[k], p.path[k + 1]) AND w.y = greatest(p.path[k], p.path[k + 1])), 0.0)) AS weight FROM paths_r p JOIN params q ON q.pid = p.pid AND q.b = p.v""",
        ("paths_r(pid, v, d, path) AS (SELECT pid, a, 0, [a::BIGINT] FROM params UNION SELECT r.pid, k.dst, r.d + 1, list_append(r.path, k.dst) FROM paths_r r JOIN knows k ON k.src = r.v JOIN params p ON p.pid = r.pid JOIN nearest n ON n.pid = r.pid AND n.v = k.dst AND n.depth = r.d + 1 JOIN nearest e ON e.pid = r.pid AND e.v = p.b AND r.d < e.depth)",),
    ),
}

"""The family and film graph of the golden queries."""

from loomgraph.functions import series
from loomgraph.plans.graph import Graph

PEOPLE = [
    ("Rachel Kempson", 1910), ("Michael Redgrave", 1908), ("Vanessa Redgrave", 1937), ("Corin Redgrave", 1939), ("Liam Neeson", 1952), ("Natasha Richardson", 1963), ("Richard Harris", 1930),
    ("Dennis Quaid", 1954), ("Lindsay Lohan", 1986), ("Jemma Redgrave", 1965), ("Roy Redgrave", 1873), ("John Williams", 1932), ("Christopher Nolan", 1970),
]
CITIES = ["New York", "London", "Houston"]
FILMS = ["Goodbye, Mr. Chips", "Batman Begins", "Harry Potter and the Sorcerer's Stone", "The Parent Trap", "Camelot"]
ID = {n: i for i, n in enumerate([*(p for p, _ in PEOPLE), *CITIES, *FILMS])}
CHILD = [(0, 2), (0, 3), (1, 2), (1, 3), (3, 9), (2, 5), (10, 1)]
MARRIED = [(0, 1), (1, 0), (5, 4), (4, 5)]
BORN = [(2, "London", 10, 20.21), (5, "London", 11, 20.18), (12, "London", 12, 19.93), (7, "Houston", 13, 19.11), (8, "New York", 14, 20.62), (11, "New York", 15, 20.55)]
ACTED = [(1, 16, "The Headmaster"), (2, 20, "Guenevere"), (6, 20, "King Arthur"), (6, 18, "Albus Dumbledore"), (5, 19, "Liz James"), (7, 19, "Nick Parker"), (8, 19, "Halle/Annie"), (4, 17, "Henri Ducard")]


def graph(spark) -> Graph:
    g = Graph.empty()
    g = g.with_vertices("Person", spark.createDataFrame([(i, n, y) for i, (n, y) in enumerate(PEOPLE)], "_vid long, name string, birthyear smallint"), "name")
    g = g.with_vertices("City", spark.createDataFrame([(ID[n], n) for n in CITIES], "_vid long, name string"), "name")
    g = g.with_vertices("Film", spark.createDataFrame([(ID[n], n) for n in FILMS], "_vid long, title string"), "title")
    pair = "_src long, _dst long"
    g = g.with_edges("HAS_CHILD", spark.createDataFrame(CHILD, pair), (("Person", "Person"),))
    g = g.with_edges("MARRIED", spark.createDataFrame(MARRIED, pair), (("Person", "Person"),))
    g = g.with_edges("BORN_IN", spark.createDataFrame([(a, ID[c], w) for a, c, _, w in BORN], pair + ", weight float"), (("Person", "City"),))
    g = g.with_edges("DIRECTED", spark.createDataFrame([(12, 17)], pair), (("Person", "Film"),))
    g = g.with_edges("WROTE_MUSIC_FOR", spark.createDataFrame([(11, 18), (11, 16)], pair), (("Person", "Film"),))
    return g.with_edges("ACTED_IN", spark.createDataFrame(ACTED, pair + ", charactername string"), (("Person", "Film"),))


def with_prices(g: Graph) -> Graph:
    spark = g.spark
    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    rows = [(i, d, None if i == 2 and k == 1 else 10.0 + k, 100 * (k + 1)) for i in range(13) for k, d in enumerate(days)]
    points = spark.createDataFrame(rows, "element long, ts string, close double, volume long")
    held = series.append(series.create(spark, "bigint", {"close": "double", "volume": "bigint"}), points.withColumn("ts", points["ts"].cast("timestamp_ntz")))
    return Graph(g.vertices, g.edges, g.vertex_labels, g.edge_labels, {("Person", "prices"): held})

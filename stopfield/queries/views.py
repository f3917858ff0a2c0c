"""Study tables derived from the driver's tables: places, stations, services, flows and areas.

The driver's tables hold no coordinates, so they come from the keys by integer arithmetic, written once for Spark (class ``Tables``) and
once as SQL (``SQL_VIEWS``). Row counts grow with the driver's tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopfield.functions import grid
from stopfield.session import tune

FINE, COARSE = 12, 8


class Tables:
    """Lazy access to the driver's tables and to the study tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def place(self) -> DataFrame:
        """Census units: id, hierarchical code, coordinates, county (nation) and state (region), income and level of service."""
        k = F.col("c_custkey")
        nation = self.read("nation").select(F.col("n_nationkey").alias("county"), F.col("n_regionkey").alias("state"))
        geoid = F.concat(
            F.lpad(F.col("state").cast("string"), 2, "0"),
            F.lpad(F.col("county").cast("string"), 3, "0"),
            F.lpad((k % 7).cast("string"), 6, "0"),
            F.expr("c_custkey div 7 % 4").cast("string"),
            F.lpad(F.expr("c_custkey div 28 % 1000").cast("string"), 3, "0"),
        )
        return (
            self.read("customer")
            .join(nation, F.col("c_nationkey") == F.col("county"))
            .select(
                k.alias("id"),
                "state",
                "county",
                geoid.alias("geoid"),
                (F.lit(-100.0) + (k * 7919 % 20000) / 1000.0).alias("lon"),
                (F.lit(30.0) + (k * 104729 % 15000) / 1000.0).alias("lat"),
                (k * 31 % 101).cast("double").alias("los"),
                F.col("c_acctbal").alias("income"),
                F.col("c_mktsegment").alias("segment"),
            )
        )

    @cached_property
    def place_weight(self) -> DataFrame:
        """Residents, jobs and votes per place: one resident per order, one job per thousand of its price."""
        n = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0))
        return self.read("orders").groupBy(F.col("o_custkey").alias("id")).agg(
            F.count("*").alias("population"),
            F.sum("o_totalprice").alias("turnover"),
            n("F").alias("dem"),
            n("O").alias("rep"),
        )

    @cached_property
    def unit(self) -> DataFrame:
        """Places with residents, jobs and votes (0 where a place has none)."""
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
        p, w = self.place, self.place_weight
        return p.join(w, "id", "left").select(
            *p.columns,
            zero("population"),
            (F.coalesce(F.col("turnover"), F.lit(0.0)) / 1000).alias("jobs"),
            zero("dem"),
            zero("rep"),
        )

    @cached_property
    def fine_cell(self) -> DataFrame:
        """Units summed on the fine grid: one row per cell."""
        return (
            self.unit.withColumn("cell", grid.cell(F.col("lon"), F.col("lat"), FINE))
            .groupBy("cell")
            .agg(
                F.min("county").alias("county"),
                F.sum("population").alias("population"),
                F.sum("jobs").alias("jobs"),
                F.max("los").alias("los"),
                F.min("income").alias("income_median"),
            )
        )

    @cached_property
    def station(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.read("supplier").select(
            k.alias("station"),
            (F.lit(-100.0) + (k * 7919 % 20000) / 1000.0).alias("lon"),
            (F.lit(30.0) + (k * 104729 % 15000) / 1000.0).alias("lat"),
            F.element_at(F.array(F.lit("bus"), F.lit("tram"), F.lit("rail")), (k % 3 + 1).cast("int")).alias("mode"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").alias("county"),
        )

    @cached_property
    def route_service(self) -> DataFrame:
        """One row per station, route and direction: headway and the distance and time of its speed."""
        return self.read("lineitem").groupBy(
            F.col("l_suppkey").alias("station"), F.col("l_partkey").alias("route"), (F.col("l_linenumber") % 2).alias("direction")
        ).agg(
            (F.lit(2) + F.min(F.col("l_quantity")) % 58).cast("double").alias("headway"),
            F.sum("l_extendedprice").alias("distance"),
            F.sum(F.lit(600) + F.lit(30) * F.col("l_quantity")).alias("time"),
        )

    @cached_property
    def departure(self) -> DataFrame:
        """Departures of stops: second of the day of every event."""
        ts = F.col("ts")
        return self.read("events").select(
            F.col("event_id").alias("dep_id"),
            (F.col("user_id") % 200).alias("stop"),
            F.col("event_type").alias("route"),
            (F.col("event_id") % 2).alias("direction"),
            F.to_date(ts).alias("day"),
            (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).alias("sec"),
        )

    @cached_property
    def flow(self) -> DataFrame:
        """Commuters from a home place to a work place."""
        return (
            self.read("orders")
            .join(self.read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(F.col("o_custkey").alias("h"), F.col("l_suppkey").alias("w"))
            .agg(F.count("*").alias("n"))
        )

    @cached_property
    def area(self) -> DataFrame:
        """Square areas of two by two degrees, one per nation, with a closed ring of (lon, lat)."""
        k = F.col("n_nationkey")
        x = F.lit(-99.0) + (k * 37 % 18)
        y = F.lit(31.0) + (k * 53 % 13)
        corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("lon"), (y + dy).cast("double").alias("lat"))
        return self.read("nation").select(
            k.alias("area"),
            F.col("n_name").alias("name"),
            (x - 1.0).alias("west"),
            (y - 1.0).alias("south"),
            (x + 1.0).alias("east"),
            (y + 1.0).alias("north"),
            F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)).alias("ring"),
        )

    @cached_property
    def trip(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.read("orders").select(
            k.alias("trip"), (F.col("o_custkey") % 8).alias("feed"), (F.col("o_custkey") % 60).alias("route"), (k % 25).alias("service"),
            (k % 2).alias("direction"),
        )

    @cached_property
    def stop_time(self) -> DataFrame:
        """Calls of trips: stop and second of departure; several lines of one order at the same number count once."""
        one = self.read("lineitem").groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq")).agg(
            F.min("l_suppkey").alias("stop"), F.min("l_quantity").cast("int").alias("wait")
        )
        return one.select("trip", "seq", "stop", (F.col("trip") * 37 % 72000 + F.col("seq") * 300 + F.col("wait") * 5).cast("int").alias("sec"))

    @cached_property
    def calendar(self) -> DataFrame:
        """A service per nation in each of eight feeds, which use the same service ids for other days: flags and a range around January 2024."""
        k, feed = F.col("n_nationkey"), F.col("feed")
        bits = (k * 37 + 31 + feed * 13) % 128
        flag = lambda i, n: F.shiftright(bits, i).bitwiseAND(F.lit(1)).alias(n)
        names = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
        start = F.date_add(F.lit("2024-01-01").cast("date"), ((k + feed) % 6).cast("int"))
        feeds = self.read("nation").withColumn("feed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
        return feeds.select(
            "feed", k.cast("long").alias("service"), *[flag(i, n).cast("int").alias(n) for i, n in enumerate(names)], start.alias("start_date"),
            F.date_add(start, (F.lit(14) + k % 11).cast("int")).alias("end_date"),
        )

    @cached_property
    def exception(self) -> DataFrame:
        """Calendar exceptions out of all events: 1 adds a service on a date, 2 removes it, other numbers change nothing."""
        keys = ((F.col("user_id") % 8).alias("feed"), (F.col("user_id") % 25).alias("service"), F.to_date("ts").alias("date"))
        return self.read("events").groupBy(*keys).agg((F.sum("event_id") % 5).cast("int").alias("exception_type"))

    @cached_property
    def frequency(self) -> DataFrame:
        k = F.col("o_orderkey")
        start = k % 18 * 3600
        return self.read("orders").select(
            k.alias("trip"), start.alias("start"), (start + (k % 4 + 1) * 1800).alias("end"), (F.lit(300) + k % 12 * 75).alias("headway")
        )

    @cached_property
    def item(self) -> DataFrame:
        """Walks from a cell (a home place) to a station, in metres, with the cell's residents and unit."""
        u = self.unit.select(F.col("id").alias("cell"), "county", "population", "jobs")
        return self.flow.join(u, F.col("h") == F.col("cell")).select(
            "cell", "county", "population", "jobs", F.col("w").alias("station"), ((F.col("h") * 13 + F.col("w") * 7) % 2500).cast("double").alias("dist")
        )

    @cached_property
    def pattern(self) -> DataFrame:
        """All service patterns of a station with headway (min) and speed (km/h)."""
        return self.route_service.join(self.station.select("station", "mode"), "station").select(
            "station", "route", "direction", "mode", F.col("headway").alias("h"), (F.col("distance") / 1000 / (F.col("time") / 3600)).alias("v")
        )

    @cached_property
    def edge(self) -> DataFrame:
        """Street edges: from every order's customer position eastwards, up to a quarter of a degree long, with a level of service."""
        k = F.col("o_orderkey")
        x0 = F.lit(-100.0) + (k * 7919 % 20000) / 1000.0
        y0 = F.lit(30.0) + (k * 104729 % 15000) / 1000.0
        return self.read("orders").select(
            k.alias("edge"),
            x0.alias("x1"),
            y0.alias("y1"),
            (x0 + (k % 9 + 1) / 36.0).alias("x2"),
            (y0 + (k % 5) / 36.0).alias("y2"),
            (k * 31 % 101).cast("double").alias("los"),
        )


CELL = "((({r}::BIGINT) << 52) | ((floor(({lat} + 180.0) * {n}.0 / 360.0)::BIGINT) << 26) | floor(({lon} + 180.0) * {n}.0 / 360.0)::BIGINT)"


def sql_cell(lon: str, lat: str, res: int) -> str:
    return CELL.format(r=res, lon=lon, lat=lat, n=1 << res)


def sql_row(cell: str) -> str:
    return f"((({cell}) >> 26) & 67108863)"


def sql_col(cell: str) -> str:
    return f"(({cell}) & 67108863)"


def sql_parent(cell: str, res: int, to: int) -> str:
    d = res - to
    return f"((({to}::BIGINT) << 52) | (({sql_row(cell)} >> {d}) << 26) | ({sql_col(cell)} >> {d}))"


def sql_centre(cell: str, res: int) -> tuple[str, str]:
    side = repr(360.0 / (1 << res))
    return f"(({sql_col(cell)} + 0.5) * {side}::DOUBLE - 180.0)", f"(({sql_row(cell)} + 0.5) * {side}::DOUBLE - 180.0)"


def sql_area(cell: str, res: int) -> str:
    side = repr(grid.side_degrees(res) * grid.METRES_PER_DEGREE / 1000.0)
    return f"({side}::DOUBLE * {side}::DOUBLE * cos(radians({sql_centre(cell, res)[1]})))"


def sql_haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"(2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(({lat2})-({lat1}))/2),2) + cos(radians({lat1}))*cos(radians({lat2}))"
        f"*pow(sin(radians(({lon2})-({lon1}))/2),2)))))"
    )


METRE = repr(grid.METRES_PER_DEGREE)


def sql_plane(lon1: str, lat1: str, lon2: str, lat2: str, lat0: str | None = None) -> str:
    mid = lat0 or f"(({lat1})+({lat2}))/2"
    return (
        f"sqrt(pow((({lon2})-({lon1}))*{METRE}::DOUBLE*cos(radians({mid})),2) + pow((({lat2})-({lat1}))*{METRE}::DOUBLE,2))"
    )


SQL_VIEWS: dict[str, str] = {
    "v_place": """
        SELECT c_custkey AS id, n_regionkey AS state, n_nationkey AS county,
               lpad(n_regionkey::VARCHAR,2,'0') || lpad(n_nationkey::VARCHAR,3,'0') || lpad((c_custkey%7)::VARCHAR,6,'0')
                 || ((c_custkey//7)%4)::VARCHAR || lpad(((c_custkey//28)%1000)::VARCHAR,3,'0') AS geoid,
               -100.0::DOUBLE + ((c_custkey*7919)%20000)::DOUBLE/1000.0 AS lon,
               30.0::DOUBLE + ((c_custkey*104729)%15000)::DOUBLE/1000.0 AS lat,
               ((c_custkey*31)%101)::DOUBLE AS los, c_acctbal AS income, c_mktsegment AS segment
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_place_weight": """
        SELECT o_custkey AS id, count(*) AS population, sum(o_totalprice) AS turnover,
               sum(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS dem, sum(CASE WHEN o_orderstatus='O' THEN 1 ELSE 0 END) AS rep
        FROM orders GROUP BY 1""",
    "v_unit": """
        SELECT p.*, coalesce(w.population,0)::DOUBLE AS population, coalesce(w.turnover,0.0)/1000 AS jobs,
               coalesce(w.dem,0)::DOUBLE AS dem, coalesce(w.rep,0)::DOUBLE AS rep
        FROM v_place p LEFT JOIN v_place_weight w USING (id)""",
    "v_fine_cell": f"""
        SELECT {sql_cell('lon', 'lat', FINE)} AS cell, min(county) AS county, sum(population) AS population, sum(jobs) AS jobs,
               max(los) AS los, min(income) AS income_median
        FROM v_unit GROUP BY 1""",
    "v_station": """
        SELECT s_suppkey AS station, -100.0::DOUBLE + ((s_suppkey*7919)%20000)::DOUBLE/1000.0 AS lon,
               30.0::DOUBLE + ((s_suppkey*104729)%15000)::DOUBLE/1000.0 AS lat,
               ['bus','tram','rail'][(s_suppkey%3+1)::INT] AS mode, s_name AS name, s_nationkey AS county
        FROM supplier""",
    "v_route_service": """
        SELECT l_suppkey AS station, l_partkey AS route, l_linenumber%2 AS direction,
               (2 + min(l_quantity)%58)::DOUBLE AS headway, sum(l_extendedprice) AS distance, sum(600 + 30*l_quantity) AS time
        FROM lineitem GROUP BY 1,2,3""",
    "v_departure": """
        SELECT event_id AS dep_id, user_id%200 AS stop, event_type AS route, event_id%2 AS direction, ts::DATE AS day,
               (extract('hour' FROM ts)*3600 + extract('minute' FROM ts)*60 + floor(extract('second' FROM ts)))::INT AS sec
        FROM events""",
    "v_flow": """
        SELECT o_custkey AS h, l_suppkey AS w, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1,2""",
    "v_area": """
        SELECT n_nationkey AS area, n_name AS name, x-1.0::DOUBLE AS west, y-1.0::DOUBLE AS south, x+1.0::DOUBLE AS east, y+1.0::DOUBLE AS north
        FROM (SELECT *, (-99.0 + (n_nationkey*37)%18)::DOUBLE AS x, (31.0 + (n_nationkey*53)%13)::DOUBLE AS y FROM nation)""",
    "v_trip": """
        SELECT o_orderkey AS trip, o_custkey%8 AS feed, o_custkey%60 AS route, o_orderkey%25 AS service, o_orderkey%2 AS direction FROM orders""",
    "v_stop_time": """
        SELECT trip, seq, stop, ((trip*37)%72000 + seq*300 + wait*5)::INT AS sec FROM (
          SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_suppkey) AS stop, min(l_quantity)::INT AS wait FROM lineitem GROUP BY 1,2)""",
    "v_calendar": """
        SELECT feed, n_nationkey::BIGINT AS service, b&1 AS monday, (b>>1)&1 AS tuesday, (b>>2)&1 AS wednesday, (b>>3)&1 AS thursday, (b>>4)&1 AS friday, (b>>5)&1 AS saturday, (b>>6)&1 AS sunday,
               DATE '2024-01-01' + ((n_nationkey+feed)%6)::INT AS start_date, DATE '2024-01-01' + ((n_nationkey+feed)%6)::INT + 14 + n_nationkey%11 AS end_date
        FROM (SELECT *, (n_nationkey*37+31+feed*13)%128 AS b FROM nation, range(8) f(feed))""",
    "v_exception": """
        SELECT user_id%8 AS feed, user_id%25 AS service, ts::DATE AS date, (sum(event_id)%5)::INT AS exception_type FROM events GROUP BY 1,2,3""",
    "v_frequency": """
        SELECT o_orderkey AS trip, o_orderkey%18*3600 AS start, o_orderkey%18*3600 + (o_orderkey%4+1)*1800 AS "end", 300 + o_orderkey%12*75 AS headway
        FROM orders""",
    "v_active": """
        SELECT feed, service, date FROM (
          SELECT feed, service, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY))::DATE AS date, monday, tuesday, wednesday, thursday, friday, saturday, sunday FROM v_calendar)
        WHERE CASE isodow(date) WHEN 1 THEN monday WHEN 2 THEN tuesday WHEN 3 THEN wednesday WHEN 4 THEN thursday WHEN 5 THEN friday WHEN 6 THEN saturday ELSE sunday END = 1
        UNION SELECT feed, service, date FROM v_exception WHERE exception_type = 1
        EXCEPT SELECT feed, service, date FROM v_exception WHERE exception_type = 2""",
    "v_day_count": """
        SELECT feed, date, sum(n)::BIGINT AS trips FROM v_active JOIN (SELECT feed, service, count(*) AS n FROM v_trip GROUP BY 1,2) USING (feed, service) GROUP BY 1,2""",
    "v_item": """
        SELECT u.id AS cell, county, population, jobs, w AS station, ((h*13+w*7)%2500)::DOUBLE AS dist FROM v_flow JOIN v_unit u ON h = u.id""",
    "v_pattern": """
        SELECT r.station, route, direction, s.mode, headway AS h, distance/1000/(time/3600) AS v FROM v_route_service r JOIN v_station s ON r.station = s.station""",
    "v_profile": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY h, route, direction) - 1 AS slot FROM v_pattern) WHERE slot < 5""",
    "v_scored_item": """
        SELECT i.*, p.slot, p.mode, p.h, p.v,
          CASE p.mode WHEN 'bus' THEN 0.7 WHEN 'tram' THEN 0.85 ELSE 1.0 END
          * (CASE WHEN p.h <= 2 THEN 1.0 WHEN p.h <= 10 THEN 1.0+(p.h-2)*(0.7-1.0)/8 WHEN p.h <= 30 THEN 0.7+(p.h-10)*(0.3-0.7)/20 WHEN p.h <= 60 THEN 0.3+(p.h-30)*(0.1-0.3)/30 ELSE 0.1 END)
          * (CASE WHEN p.v <= 5 THEN 0.2 WHEN p.v <= 20 THEN 0.2+(p.v-5)*(0.6-0.2)/15 WHEN p.v <= 50 THEN 0.6+(p.v-20)*(1.0-0.6)/30 ELSE 1.0 END)
          * pow(1 + i.dist/(CASE p.mode WHEN 'bus' THEN 500.0 WHEN 'tram' THEN 700.0 ELSE 900.0 END), -1.5) AS value
        FROM v_item i JOIN v_profile p ON i.station = p.station""",
    "v_edge": """
        SELECT o_orderkey AS edge, x0 AS x1, y0 AS y1, x0 + (o_orderkey%9+1)::DOUBLE/36.0 AS x2, y0 + (o_orderkey%5)::DOUBLE/36.0 AS y2,
               ((o_orderkey*31)%101)::DOUBLE AS los
        FROM (SELECT *, -100.0::DOUBLE + ((o_orderkey*7919)%20000)::DOUBLE/1000.0 AS x0, 30.0::DOUBLE + ((o_orderkey*104729)%15000)::DOUBLE/1000.0 AS y0
              FROM orders)""",
}

"""State-plane zones of NAD83 as a fixed table, and the index that finds a point's zone.

Angles are degrees, or degrees:minutes; a scale of 1:n on the central meridian is 1 - 1/n.  Areas of use are boxes, rounded to hundredths of
a degree and partly to tenths; boxes of neighbouring zones overlap, and the smallest that holds a point is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOOT, US_FOOT = 0.3048, 1200 / 3937

#: Fixed values (published definitions): code; name; kind; origin's latitude; central meridian; scale or two parallels (for the
#: oblique kind scale and azimuth's tangent); false easting; false northing (metres); unit; west, south, east, north.
TABLE = """
9748; Alabama East (ftUS); tm; 30:30; -85:50; 1:25000; 200000; 0; us; -86.79 30.99 -84.89 35.01
9749; Alabama West (ftUS); tm; 30; -87:30; 1:15000; 600000; 0; us; -88.48 30.14 -86.3 35.02
26931; Alaska zone 1; om; 57; -133:40; 1:10000 -0.75; 5000000; -5000000; m; -141 54.61 -129.99 60.35
26932; Alaska zone 2; tm; 54; -142; 1:10000; 500000; 0; m; -144.01 59.72 -140.98 70.16
26933; Alaska zone 3; tm; 54; -146; 1:10000; 500000; 0; m; -148 59.72 -144 70.38
26934; Alaska zone 4; tm; 54; -150; 1:10000; 500000; 0; m; -152.01 59.11 -147.99 70.63
26935; Alaska zone 5; tm; 54; -154; 1:10000; 500000; 0; m; -156 55.72 -151.86 71.28
26936; Alaska zone 6; tm; 54; -158; 1:10000; 500000; 0; m; -160 54.89 -155.99 71.4
26937; Alaska zone 7; tm; 54; -162; 1:10000; 500000; 0; m; -164.01 54.32 -160 70.74
26938; Alaska zone 8; tm; 54; -166; 1:10000; 500000; 0; m; -168.26 54.34 -164 69.05
26939; Alaska zone 9; tm; 54; -170; 1:10000; 500000; 0; m; -173.16 56.49 -168 65.82
26940; Alaska zone 10; lcc; 51; -176; 53:50 51:50; 1000000; 0; m; -180 51.3 -164.84 54.34
2222; Arizona East (ft); tm; 31; -110:10; 1:10000; 213360; 0; ft; -111.71 31.33 -109.04 37.01
2223; Arizona Central (ft); tm; 31; -111:55; 1:10000; 213360; 0; ft; -113.35 31.33 -110.44 37.01
2224; Arizona West (ft); tm; 31; -113:45; 1:15000; 213360; 0; ft; -114.81 32.05 -112.52 37
3433; Arkansas North (ftUS); lcc; 34:20; -92; 36:14 34:56; 400000; 0; us; -94.62 34.67 -89.64 36.5
3434; Arkansas South (ftUS); lcc; 32:40; -92; 34:46 33:18; 400000; 400000; us; -94.48 33.01 -90.4 35.1
2225; California zone 1 (ftUS); lcc; 39:20; -122; 41:40 40; 2000000; 500000; us; -124.45 39.59 -119.99 42.01
2226; California zone 2 (ftUS); lcc; 37:40; -122; 39:50 38:20; 2000000; 500000; us; -124.06 38.02 -119.54 40.16
2227; California zone 3 (ftUS); lcc; 36:30; -120:30; 38:26 37:04; 2000000; 500000; us; -123.02 36.73 -117.83 38.71
2228; California zone 4 (ftUS); lcc; 35:20; -119; 37:15 36; 2000000; 500000; us; -122.01 35.78 -115.62 37.58
2229; California zone 5 (ftUS); lcc; 33:30; -118; 35:28 34:02; 2000000; 500000; us; -121.42 32.76 -114.12 35.81
2230; California zone 6 (ftUS); lcc; 32:10; -116:15; 33:53 32:47; 2000000; 500000; us; -118.15 32.53 -114.42 34.08
2231; Colorado North (ftUS); lcc; 39:20; -105:30; 40:47 39:43; 914401.8289; 304800.6096; us; -109.06 39.56 -102.04 41.01
2232; Colorado Central (ftUS); lcc; 37:50; -105:30; 39:45 38:27; 914401.8289; 304800.6096; us; -109.06 38.14 -102.04 40.09
2233; Colorado South (ftUS); lcc; 36:40; -105:30; 38:26 37:14; 914401.8289; 304800.6096; us; -109.06 36.98 -102.04 38.68
2234; Connecticut (ftUS); lcc; 40:50; -72:45; 41:52 41:12; 304800.6096; 152400.3048; us; -73.73 40.98 -71.78 42.05
2235; Delaware (ftUS); tm; 38; -75:25; 1:200000; 200000; 0; us; -75.8 38.44 -74.97 39.85
2236; Florida East (ftUS); tm; 24:20; -81; 1:17000; 200000; 0; us; -82.33 24.41 -79.97 30.83
2237; Florida West (ftUS); tm; 24:20; -82; 1:17000; 200000; 0; us; -83.34 26.27 -81.13 29.6
2238; Florida North (ftUS); lcc; 29; -84:30; 30:45 29:35; 600000; 0; us; -87.63 29.21 -82.04 31.01
2239; Georgia East (ftUS); tm; 30; -82:10; 1:10000; 200000; 0; us; -83.47 30.36 -80.77 34.68
2240; Georgia West (ftUS); tm; 30; -84:10; 1:10000; 700000; 0; us; -85.61 30.62 -82.99 35.01
26961; Hawaii zone 1; tm; 18:50; -155:30; 1:30000; 500000; 0; m; -156.1 18.87 -154.74 20.33
26962; Hawaii zone 2; tm; 20:20; -156:40; 1:30000; 500000; 0; m; -157.36 20.45 -155.93 21.26
26963; Hawaii zone 3; tm; 21:10; -158; 1:100000; 500000; 0; m; -158.33 21.2 -157.61 21.75
26964; Hawaii zone 4; tm; 21:50; -159:30; 1:100000; 500000; 0; m; -159.85 21.81 -159.23 22.29
26965; Hawaii zone 5; tm; 21:40; -160:10; 1; 500000; 0; m; -160.3 21.73 -159.99 22.07
2241; Idaho East (ftUS); tm; 41:40; -112:10; 1:19000; 200000; 0; us; -113.24 41.99 -111.04 44.75
2242; Idaho Central (ftUS); tm; 41:40; -114; 1:19000; 500000; 0; us; -115.3 41.99 -112.68 45.7
2243; Idaho West (ftUS); tm; 41:40; -115:45; 1:15000; 800000; 0; us; -117.24 41.99 -114.32 49.01
3435; Illinois East (ftUS); tm; 36:40; -88:20; 1:40000; 300000; 0; us; -89.28 37.06 -87.02 42.5
3436; Illinois West (ftUS); tm; 36:40; -90:10; 1:17000; 700000; 0; us; -91.52 36.98 -88.93 42.51
2965; Indiana East (ftUS); tm; 37:30; -85:40; 1:30000; 100000; 250000; us; -86.59 37.95 -84.78 41.77
2966; Indiana West (ftUS); tm; 37:30; -87:05; 1:30000; 900000; 250000; us; -88.06 37.77 -86.24 41.77
3417; Iowa North (ftUS); lcc; 41:30; -93:30; 43:16 42:04; 1500000; 1000000; us; -96.65 41.85 -90.15 43.51
3418; Iowa South (ftUS); lcc; 40; -93:30; 41:47 40:37; 500000; 0; us; -96.14 40.37 -90.14 42.04
3419; Kansas North (ftUS); lcc; 38:20; -98; 39:47 38:43; 400000; 0; us; -102.06 38.52 -94.58 40.01
3420; Kansas South (ftUS); lcc; 36:40; -98:30; 38:34 37:16; 400000; 400000; us; -102.05 36.99 -94.6 38.88
2246; Kentucky North (ftUS); lcc; 37:30; -84:15; 38:58 37:58; 500000; 0; us; -85.96 37.71 -82.47 39.15
2247; Kentucky South (ftUS); lcc; 36:20; -85:45; 37:56 36:44; 500000; 500000; us; -89.57 36.49 -81.95 38.17
3451; Louisiana North (ftUS); lcc; 30:30; -92:30; 32:40 31:10; 1000000; 0; us; -94.05 30.85 -90.86 33.03
3452; Louisiana South (ftUS); lcc; 28:30; -91:20; 30:42 29:18; 1000000; 0; us; -93.94 28.85 -88.75 31.07
26847; Maine East (ftUS); tm; 43:40; -68:30; 1:10000; 300000; 0; us; -70.03 43.88 -66.91 47.47
26848; Maine West (ftUS); tm; 42:50; -70:10; 1:30000; 900000; 0; us; -71.09 43.04 -69.26 46.58
2248; Maryland (ftUS); lcc; 37:40; -77; 39:27 38:18; 400000; 0; us; -79.49 37.97 -74.97 39.73
2249; Massachusetts Mainland (ftUS); lcc; 41; -71:30; 42:41 41:43; 200000; 750000; us; -73.5 41.46 -69.86 42.89
2250; Massachusetts Island (ftUS); lcc; 41; -70:30; 41:29 41:17; 500000; 0; us; -70.91 41.19 -69.89 41.51
2251; Michigan North (ft); lcc; 44:47; -87; 47:05 45:29; 8000000; 0; ft; -90.42 45.08 -83.44 48.32
2252; Michigan Central (ft); lcc; 43:19; -84:22; 45:42 44:11; 6000000; 0; ft; -87.06 43.8 -82.27 45.92
2253; Michigan South (ft); lcc; 41:30; -84:22; 43:40 42:06; 4000000; 0; ft; -87.2 41.69 -82.13 44.22
26849; Minnesota North (ftUS); lcc; 46:30; -93:06; 48:38 47:02; 800000; 100000; us; -97.22 46.64 -89.49 49.38
26850; Minnesota Central (ftUS); lcc; 45; -94:15; 47:03 45:37; 800000; 100000; us; -96.86 45.28 -92.29 47.48
26851; Minnesota South (ftUS); lcc; 43; -94; 45:13 43:47; 800000; 100000; us; -96.85 43.49 -91.21 45.59
2254; Mississippi East (ftUS); tm; 29:30; -88:50; 1:20000; 300000; 0; us; -89.97 30.01 -88.09 35.01
2255; Mississippi West (ftUS); tm; 29:30; -90:20; 1:20000; 700000; 0; us; -91.65 31 -89.37 35.01
26996; Missouri East; tm; 35:50; -90:30; 1:15000; 250000; 0; m; -91.97 35.98 -89.1 40.61
26997; Missouri Central; tm; 35:50; -92:30; 1:15000; 500000; 0; m; -93.79 36.48 -91.41 40.61
26998; Missouri West; tm; 36:10; -94:30; 1:17000; 850000; 0; m; -95.77 36.48 -93.48 40.59
2256; Montana (ft); lcc; 44:15; -109:30; 49 45; 600000; 0; ft; -116.07 44.35 -104.04 49.01
26852; Nebraska (ftUS); lcc; 39:50; -100; 43 40; 500000; 0; us; -104.06 39.99 -95.3 43.01
3421; Nevada East (ftUS); tm; 34:45; -115:35; 1:10000; 200000; 8000000; us; -117.01 34.99 -114.03 42
3422; Nevada Central (ftUS); tm; 34:45; -116:40; 1:10000; 500000; 6000000; us; -118.19 36 -114.99 41
3423; Nevada West (ftUS); tm; 34:45; -118:35; 1:10000; 800000; 4000000; us; -120 36.95 -116.99 42
3437; New Hampshire (ftUS); tm; 42:30; -71:40; 1:30000; 300000; 0; us; -72.56 42.69 -70.63 45.31
3424; New Jersey (ftUS); tm; 38:50; -74:30; 1:10000; 150000; 0; us; -75.6 38.87 -73.88 41.36
2257; New Mexico East (ftUS); tm; 31; -104:20; 1:11000; 165000; 0; us; -105.72 32 -102.99 37
2258; New Mexico Central (ftUS); tm; 31; -106:15; 1:10000; 500000; 0; us; -107.73 31.78 -104.84 37
2259; New Mexico West (ftUS); tm; 31; -107:50; 1:12000; 830000; 0; us; -109.06 31.33 -106.32 37
2260; New York East (ftUS); tm; 38:50; -74:30; 1:10000; 150000; 0; us; -75.87 40.88 -73.23 45.02
2261; New York Central (ftUS); tm; 40; -76:35; 1:16000; 250000; 0; us; -77.75 41.99 -75.04 44.41
2262; New York West (ftUS); tm; 40; -78:35; 1:16000; 350000; 0; us; -79.77 41.99 -77.36 43.64
2263; New York Long Island (ftUS); lcc; 40:10; -74; 41:02 40:40; 300000; 0; us; -74.26 40.47 -71.8 41.3
2264; North Carolina (ftUS); lcc; 33:45; -79; 36:10 34:20; 609601.22; 0; us; -84.33 33.83 -75.38 36.59
2265; North Dakota North (ft); lcc; 47; -100:30; 48:44 47:26; 600000; 0; ft; -104.07 47.15 -96.83 49.01
2266; North Dakota South (ft); lcc; 45:40; -100:30; 47:29 46:11; 600000; 0; ft; -104.05 45.93 -96.55 47.83
3734; Ohio North (ftUS); lcc; 39:40; -82:30; 41:42 40:26; 600000; 0; us; -84.81 40.1 -80.51 42.33
3735; Ohio South (ftUS); lcc; 38; -82:30; 40:02 38:44; 600000; 0; us; -84.83 38.4 -80.7 40.36
2267; Oklahoma North (ftUS); lcc; 35; -98; 36:46 35:34; 600000; 0; us; -103 35.27 -94.42 37.01
2268; Oklahoma South (ftUS); lcc; 33:20; -98; 35:14 33:56; 600000; 0; us; -100 33.62 -94.42 35.57
2269; Oregon North (ft); lcc; 43:40; -120:30; 46 44:20; 2500000; 0; ft; -124.17 43.95 -116.47 46.26
2270; Oregon South (ft); lcc; 41:40; -120:30; 44 42:20; 1500000; 0; ft; -124.6 41.98 -116.9 44.56
2271; Pennsylvania North (ftUS); lcc; 40:10; -77:45; 41:57 40:53; 600000; 0; us; -80.53 40.6 -74.7 42.53
2272; Pennsylvania South (ftUS); lcc; 39:20; -77:45; 40:58 39:56; 600000; 0; us; -80.53 39.71 -74.72 41.18
32161; Puerto Rico & Virgin Is.; lcc; 17:50; -66:26; 18:26 18:02; 200000; 200000; m; -67.97 17.62 -64.51 18.57
3438; Rhode Island (ftUS); tm; 41:05; -71:30; 1:160000; 100000; 0; us; -71.85 41.13 -71.08 42.02
2273; South Carolina (ft); lcc; 31:50; -81; 34:50 32:30; 609600; 0; ft; -83.36 32.05 -78.52 35.21
4457; South Dakota North (ftUS); lcc; 43:50; -100; 45:41 44:25; 600000; 0; us; -104.07 44.14 -96.45 45.95
3455; South Dakota South (ftUS); lcc; 42:20; -100:20; 44:24 42:50; 600000; 0; us; -104.06 42.48 -96.43 44.79
2274; Tennessee (ftUS); lcc; 34:20; -86; 36:25 35:15; 600000; 0; us; -90.31 34.98 -81.65 36.68
2275; Texas North (ftUS); lcc; 34; -101:30; 36:11 34:39; 200000; 1000000; us; -103.03 34.3 -99.99 36.5
2276; Texas North Central (ftUS); lcc; 31:40; -98:30; 33:58 32:08; 600000; 2000000; us; -103.07 31.72 -94 34.58
2277; Texas Central (ftUS); lcc; 29:40; -100:20; 31:53 30:07; 700000; 3000000; us; -106.66 29.78 -93.5 32.27
2278; Texas South Central (ftUS); lcc; 27:50; -99; 30:17 28:23; 600000; 4000000; us; -105 27.78 -93.76 30.67
2279; Texas South (ftUS); lcc; 25:40; -98:30; 27:50 26:10; 300000; 5000000; us; -100.2 25.83 -96.85 28.21
3560; Utah North (ftUS); lcc; 40:20; -111:30; 41:47 40:43; 500000; 1000000; us; -114.04 40.55 -109.04 42.01
3566; Utah Central (ftUS); lcc; 38:20; -111:30; 40:39 39:01; 500000; 2000000; us; -114.05 38.49 -109.04 41.08
3567; Utah South (ftUS); lcc; 36:40; -111:30; 38:21 37:13; 500000; 3000000; us; -114.05 36.99 -109.04 38.58
5646; Vermont (ftUS); tm; 42:30; -72:30; 1:28000; 500000; 0; us; -73.44 42.72 -71.5 45.03
2283; Virginia North (ftUS); lcc; 37:40; -78:30; 39:12 38:02; 3500000; 2000000; us; -80.06 37.77 -76.51 39.46
2284; Virginia South (ftUS); lcc; 36:20; -78:30; 37:58 36:46; 3500000; 1000000; us; -83.68 36.54 -75.31 38.28
2285; Washington North (ftUS); lcc; 47; -120:50; 48:44 47:30; 500000; 0; us; -124.79 47.08 -117.02 49.05
2286; Washington South (ftUS); lcc; 45:20; -120:30; 47:20 45:50; 500000; 0; us; -124.4 45.54 -116.91 47.61
26853; West Virginia North (ftUS); lcc; 38:30; -79:30; 40:15 39; 600000; 0; us; -81.76 38.76 -77.72 40.64
26854; West Virginia South (ftUS); lcc; 37; -81; 38:53 37:29; 600000; 0; us; -82.65 37.2 -79.05 39.17
2287; Wisconsin North (ftUS); lcc; 45:10; -90; 46:46 45:34; 600000; 0; us; -92.89 45.37 -88.05 47.31
2288; Wisconsin Central (ftUS); lcc; 43:50; -90; 45:30 44:15; 600000; 0; us; -92.89 43.98 -86.25 45.8
2289; Wisconsin South (ftUS); lcc; 42; -90; 44:04 42:44; 600000; 0; us; -91.43 42.48 -86.95 44.33
3736; Wyoming East (ftUS); tm; 40:30; -105:10; 1:16000; 200000; 0; us; -106.33 40.99 -104.05 45.01
3737; Wyoming East Central (ftUS); tm; 40:30; -107:20; 1:16000; 400000; 100000; us; -108.63 40.99 -106 45.01
3738; Wyoming West Central (ftUS); tm; 40:30; -108:45; 1:16000; 600000; 0; us; -110 40.99 -107.5 45.01
3739; Wyoming West (ftUS); tm; 40:30; -110:05; 1:16000; 800000; 100000; us; -111.06 40.99 -109.04 44.67
"""
_PLACES = ("zone", "North", "South", "East", "West", "Central", "Mainland", "Island", "Long", "(ftUS)", "(ft)")


def _degrees(text: str) -> float:
    whole, _, minutes = text.partition(":")
    return math.copysign(abs(float(whole)) + float(minutes or 0) / 60, -1 if text.startswith("-") else 1)


def _scale(text: str) -> float:
    one, _, n = text.partition(":")
    return 1 - 1 / float(n) if n else float(one)


def _state(name: str) -> str:
    """The zone's name without what tells zones of a state apart (West Virginia, North Dakota and the like keep their first word)."""
    if name.startswith("Rhode Island"):
        return "Rhode Island"
    words = name.split()
    end = next((k for k in range(1, len(words)) if words[k] in _PLACES or words[k].isdigit()), len(words))
    return " ".join(words[:end])


def parsed() -> list[dict]:
    """The table's rows as arguments of a zone."""
    out = []
    for line in TABLE.strip().splitlines():
        code, name, kind, lat0, lon0, shape, east, north, unit, box = (x.strip() for x in line.split(";"))
        shape = shape.split()
        lat1, lat2 = map(_degrees, shape) if kind == "lcc" else (0.0, 0.0)
        azimuth = math.degrees(math.atan(float(shape[1]))) if kind == "om" else 0.0
        out.append({"epsg": int(code), "name": f"NAD83 / {name}", "state": _state(name), "kind": kind, "lat0": _degrees(lat0), "lon0": _degrees(lon0), "k0": 1.0 if kind == "lcc" else _scale(shape[0]), "false_east": float(east), "false_north": float(north), "lat1": lat1, "lat2": lat2, "azimuth": azimuth, "unit": {"us": US_FOOT, "ft": FOOT, "m": 1.0}[unit], "bounds": tuple(map(float, box.split()))})
    return out


def zone_index(spark: SparkSession, zones: DataFrame, cell: float = 1.0) -> DataFrame:
    """cell_x, cell_y and the zones there, smallest area first.  ``zones``: epsg, name, state, west, south, east, north; a fixed table."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    cells = zones.withColumn("cell_x", F.explode(span("west", "east"))).withColumn("cell_y", F.explode(span("south", "north")))
    size = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    return cells.groupBy("cell_x", "cell_y").agg(F.sort_array(F.collect_list(F.struct(size.alias("size"), "epsg", "name", "state", "west", "south", "east", "north"))).alias("zones"))


def with_zone(points: DataFrame, index: DataFrame, state: Column | None = None, cell: float = 1.0) -> DataFrame:
    """``points`` (lon, lat and others) with epsg and zone_name of the smallest area of use that holds each; null outside of all.

    ``state``: only zones whose name holds it.  The index is a few thousand rows whatever the points are, so it is broadcast.
    """
    joined = points.withColumns({"cell_x": F.floor(F.col("lon") / cell), "cell_y": F.floor(F.col("lat") / cell)})
    if state is not None:
        joined = joined.withColumn("_wanted", F.lower(state))

    def holds(z: Column) -> Column:
        inside = F.col("lon").between(z["west"], z["east"]) & F.col("lat").between(z["south"], z["north"])
        return inside if state is None else inside & (F.col("_wanted").isNull() | F.contains(F.lower(z["name"]), F.col("_wanted")))

    found = joined.join(F.broadcast(index), ["cell_x", "cell_y"], "left").withColumn("_zone", F.get(F.filter("zones", holds), 0))
    return found.select(*points.columns, F.col("_zone.epsg").alias("epsg"), F.col("_zone.name").alias("zone_name"))

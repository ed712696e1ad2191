"""Places: a registry, the nearest place of a point and the place that a text names."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.scalars import gps_label, haversine_m


class Place(NamedTuple):
    name: str
    city: str
    country: str
    lat: float
    lon: float
    radius_m: float
    keywords: tuple[str, ...] = ()


#: Landmarks and the words that name them.
LANDMARKS = (
    Place("Taj Mahal", "Agra", "India", 27.1751, 78.0421, 1600, ("taj mahal", "taj ganj", "mumtaz", "shah jahan", "tajmahal", "mehtab bagh")),
    Place("Agra Fort", "Agra", "India", 27.1795, 78.0211, 1400, ("agra fort", "red fort agra", "diwan-i-khas", "sheesh mahal agra")),
    Place("Fatehpur Sikri", "Agra", "India", 27.0945, 77.6679, 2000, ("fatehpur sikri", "buland darwaza", "salim chishti")),
    Place("Humayun's Tomb", "Delhi", "India", 28.5933, 77.2507, 1200, ("humayun", "humayun's tomb", "nizamuddin", "isa khan", "sunder nursery")),
    Place("Safdarjung Tomb & Lodhi", "Delhi", "India", 28.5994, 77.2058, 1400, ("safdarjung", "lodhi garden", "lodhi gardens", "safdarjung tomb")),
    Place("Red Fort", "Delhi", "India", 28.6562, 77.2410, 1300, ("red fort", "lal qila", "chandni chowk", "lahori gate", "meena bazaar")),
    Place("India Gate", "Delhi", "India", 28.6129, 77.2295, 1200, ("india gate", "kartavya path", "rajpath", "amar jawan jyoti", "national war memorial")),
    Place("Qutub Minar", "Delhi", "India", 28.5245, 77.1855, 1300, ("qutub minar", "qutab minar", "iron pillar", "mehrauli", "ala-i-darwaza")),
    Place("Lotus Temple", "Delhi", "India", 28.5535, 77.2588, 1200, ("lotus temple", "bahai house of worship", "kalkaji")),
    Place("Akshardham Temple", "Delhi", "India", 28.6127, 77.2773, 1500, ("akshardham", "swaminarayan akshardham", "akshardham temple")),
    Place("Jama Masjid", "Delhi", "India", 28.6507, 77.2334, 800, ("jama masjid", "masjid-i-jehan-numa")),
    Place("Gateway of India", "Mumbai", "India", 18.9220, 72.8347, 1000, ("gateway of india", "taj mahal palace mumbai", "colaba")),
    Place("Marine Drive", "Mumbai", "India", 18.9432, 72.8230, 2000, ("marine drive", "queen's necklace", "nariman point", "girgaon chowpatty")),
    Place("Hawa Mahal", "Jaipur", "India", 26.9239, 75.8267, 1000, ("hawa mahal", "palace of winds", "badi choupad")),
    Place("Amer Fort", "Jaipur", "India", 26.9855, 75.8513, 1800, ("amer fort", "amber fort", "maota lake", "sheesh mahal jaipur")),
    Place("Virupaksha Temple", "Hampi", "India", 15.3353, 76.4597, 1800, ("hampi", "virupaksha", "hampi bazaar", "tungabhadra", "hemakuta")),
    Place("Vijaya Vittala & Stone Chariot", "Hampi", "India", 15.3429, 76.4757, 2000, ("vittala", "stone chariot", "musical pillars", "vittala temple", "hampi", "vijayanagara")),
    Place("Lotus Mahal & Elephant Stables", "Hampi", "India", 15.3204, 76.4705, 1800, ("lotus mahal", "elephant stables", "zenana enclosure", "matanga hill", "hampi")),
    Place("Mahalaxmi Temple (Ambabai)", "Kolhapur", "India", 16.6946, 74.2238, 1800, ("mahalaxmi temple", "ambabai", "kolhapur", "shree ambabai", "bhavani mandap")),
    Place("Rankala Lake", "Kolhapur", "India", 16.6908, 74.2104, 1800, ("rankala", "rankala lake", "shalini palace", "padmaraje")),
    Place("Panhala Fort", "Kolhapur", "India", 16.8118, 74.1122, 3000, ("panhala", "panhala fort", "sajja kothi", "teen darwaza")),
    Place("Lalbagh Botanical Garden", "Bangalore", "India", 12.9507, 77.5848, 1600, ("lalbagh", "lal bagh", "glass house", "lalbagh botanical garden", "lalbagh lake", "west gate lalbagh")),
    Place("Basavanagudi & Bull Temple", "Bangalore", "India", 12.9422, 77.5756, 1600, ("basavanagudi", "bull temple", "dodda ganapathi", "dodda basavanagudi", "bugle rock", "gandhi bazaar", "vidyarthi bhavan", "durga gudi")),
    Place("Gobbi Goodu Resort", "Bangalore", "India", 12.8250, 77.4650, 3000, ("gobi goodu", "gobbi goodu", "gobbi guudu", "gubbi goodu", "gobbi goodu resort", "gobi goodu resort")),
    Place("Cubbon Park & Vidhana Soudha", "Bangalore", "India", 12.9767, 77.5925, 1800, ("cubbon park", "vidhana soudha", "attara kacheri")),
    Place("Bangalore Palace", "Bangalore", "India", 12.9988, 77.5921, 1600, ("bangalore palace", "bengaluru palace")),
    Place("Eiffel Tower", "Paris", "France", 48.8584, 2.2945, 1000, ("eiffel tower", "tour eiffel", "champ de mars")),
    Place("Colosseum", "Rome", "Italy", 41.8902, 12.4922, 1000, ("colosseum", "colosseo", "roman forum")),
    Place("Statue of Liberty", "New York", "USA", 40.6892, -74.0445, 1000, ("statue of liberty", "liberty island", "ellis island")),
    Place("Burj Khalifa", "Dubai", "UAE", 25.1972, 55.2744, 1200, ("burj khalifa", "dubai mall", "downtown dubai")),
)
#: Cities.
CITIES = (
    Place("Bangalore", "Bangalore", "India", 12.9716, 77.5946, 40000),
    Place("Mysuru", "Mysuru", "India", 12.2958, 76.6394, 25000),
    Place("Hampi", "Hampi", "India", 15.335, 76.46, 20000),
    Place("Coorg", "Coorg", "India", 12.3375, 75.8069, 35000),
    Place("Mangalore", "Mangalore", "India", 12.9141, 74.856, 25000),
    Place("Gokarna", "Gokarna", "India", 14.5479, 74.3188, 20000),
    Place("Chikmagalur", "Chikmagalur", "India", 13.3161, 75.772, 25000),
    Place("Mumbai", "Mumbai", "India", 19.076, 72.8777, 40000),
    Place("Pune", "Pune", "India", 18.5204, 73.8567, 30000),
    Place("Goa", "Goa", "India", 15.2993, 74.124, 50000),
    Place("Kolhapur", "Kolhapur", "India", 16.705, 74.2433, 25000),
    Place("Mahabaleshwar", "Mahabaleshwar", "India", 17.9237, 73.6586, 25000),
    Place("Lonavala", "Lonavala", "India", 18.7557, 73.4091, 20000),
    Place("Nagpur", "Nagpur", "India", 21.1458, 79.0882, 30000),
    Place("Nashik", "Nashik", "India", 19.9975, 73.7898, 25000),
    Place("Shirdi", "Shirdi", "India", 19.7645, 74.4762, 20000),
    Place("Aurangabad", "Aurangabad", "India", 19.8762, 75.3433, 25000),
    Place("Chennai", "Chennai", "India", 13.0827, 80.2707, 35000),
    Place("Pondicherry", "Pondicherry", "India", 11.9416, 79.8083, 25000),
    Place("Ooty", "Ooty", "India", 11.4102, 76.695, 25000),
    Place("Kodaikanal", "Kodaikanal", "India", 10.2381, 77.4892, 20000),
    Place("Coimbatore", "Coimbatore", "India", 11.0168, 76.9558, 30000),
    Place("Madurai", "Madurai", "India", 9.9252, 78.1198, 25000),
    Place("Kochi", "Kochi", "India", 9.9312, 76.2673, 30000),
    Place("Munnar", "Munnar", "India", 10.0889, 77.0595, 25000),
    Place("Alleppey", "Alleppey", "India", 9.4981, 76.3388, 25000),
    Place("Wayanad", "Wayanad", "India", 11.6854, 76.132, 30000),
    Place("Trivandrum", "Trivandrum", "India", 8.5241, 76.9366, 25000),
    Place("Hyderabad", "Hyderabad", "India", 17.385, 78.4867, 35000),
    Place("Visakhapatnam", "Visakhapatnam", "India", 17.6868, 83.2185, 30000),
    Place("Tirupati", "Tirupati", "India", 13.6288, 79.4192, 25000),
    Place("Vijayawada", "Vijayawada", "India", 16.5062, 80.648, 25000),
    Place("Delhi", "Delhi", "India", 28.6139, 77.209, 35000),
    Place("Agra", "Agra", "India", 27.1767, 78.0081, 25000),
    Place("Jaipur", "Jaipur", "India", 26.9124, 75.7873, 30000),
    Place("Udaipur", "Udaipur", "India", 24.5854, 73.7125, 25000),
    Place("Jodhpur", "Jodhpur", "India", 26.2389, 73.0243, 25000),
    Place("Jaisalmer", "Jaisalmer", "India", 26.9157, 70.9083, 25000),
    Place("Varanasi", "Varanasi", "India", 25.3176, 82.9739, 25000),
    Place("Lucknow", "Lucknow", "India", 26.8467, 80.9462, 30000),
    Place("Manali", "Manali", "India", 32.2396, 77.1887, 20000),
    Place("Shimla", "Shimla", "India", 31.1048, 77.1734, 20000),
    Place("Rishikesh", "Rishikesh", "India", 30.0869, 78.2676, 20000),
    Place("Chandigarh", "Chandigarh", "India", 30.7333, 76.7794, 25000),
    Place("Amritsar", "Amritsar", "India", 31.634, 74.8723, 25000),
    Place("Srinagar", "Srinagar", "India", 34.0837, 74.7973, 25000),
    Place("Leh", "Leh", "India", 34.1526, 77.5771, 25000),
    Place("Kolkata", "Kolkata", "India", 22.5726, 88.3639, 35000),
    Place("Darjeeling", "Darjeeling", "India", 27.041, 88.2663, 20000),
    Place("Gangtok", "Gangtok", "India", 27.3389, 88.6065, 20000),
    Place("Bhubaneswar", "Bhubaneswar", "India", 20.2961, 85.8245, 25000),
    Place("Puri", "Puri", "India", 19.8135, 85.8312, 20000),
    Place("Ahmedabad", "Ahmedabad", "India", 23.0225, 72.5714, 30000),
    Place("Bhopal", "Bhopal", "India", 23.2599, 77.4126, 30000),
    Place("Indore", "Indore", "India", 22.7196, 75.8577, 25000),
    Place("Dubai", "Dubai", "UAE", 25.2048, 55.2708, 40000),
    Place("Singapore", "Singapore", "Singapore", 1.3521, 103.8198, 30000),
    Place("London", "London", "UK", 51.5074, -0.1278, 40000),
    Place("Paris", "Paris", "France", 48.8566, 2.3522, 35000),
    Place("Rome", "Rome", "Italy", 41.9028, 12.4964, 35000),
    Place("Barcelona", "Barcelona", "Spain", 41.3879, 2.1699, 30000),
    Place("Amsterdam", "Amsterdam", "Netherlands", 52.3676, 4.9041, 30000),
    Place("Bangkok", "Bangkok", "Thailand", 13.7563, 100.5018, 35000),
    Place("Bali", "Bali", "Indonesia", -8.3405, 115.092, 50000),
    Place("Tokyo", "Tokyo", "Japan", 35.6762, 139.6503, 45000),
    Place("New York", "New York", "USA", 40.7128, -74.006, 40000),
    Place("San Francisco", "San Francisco", "USA", 37.7749, -122.4194, 35000),
    Place("Los Angeles", "Los Angeles", "USA", 34.0522, -118.2437, 45000),
    Place("Sydney", "Sydney", "Australia", -33.8688, 151.2093, 40000),
    Place("Melbourne", "Melbourne", "Australia", -37.8136, 144.9631, 40000),
)
#: Words beside a city's name that make a text speak of a visit.
CLUES = ("airport", "station", "metro", "terminal", "cantt", "junction", "hotel", "resort", "visit", "tourism", "welcome to")
NEAR_M = 120_000


def place_cells(spark, landmarks: Sequence[Place] = LANDMARKS, cities: Sequence[Place] = CITIES) -> DataFrame:
    """``(cell_lat, cell_lon, places)``: the registry by one-degree cells that a place can reach, made from the registry alone and so of bounded size."""
    rows = []
    for kind, own in enumerate((landmarks, cities)):
        for order, p in enumerate(own):
            lat = math.ceil(NEAR_M / 111_000)
            lon = math.ceil(NEAR_M / (111_000 * max(0.05, math.cos(math.radians(min(89, abs(p.lat) + lat))))))
            rows += [(a, (b + 180) % 360 - 180, kind, order, p.name, p.city, p.country, p.lat, p.lon, float(p.radius_m)) for a in range(math.floor(p.lat) - lat, math.floor(p.lat) + lat + 1) for b in range(math.floor(p.lon) - lon, math.floor(p.lon) + lon + 1)]
    cells = spark.createDataFrame(rows, "cell_lat long, cell_lon long, kind int, `order` int, name string, city string, country string, lat double, lon double, radius double")
    return cells.groupBy("cell_lat", "cell_lon").agg(F.collect_list(F.struct("kind", "order", "name", "city", "country", "lat", "lon", "radius")).alias("places"))


def reverse_geocoded(df: DataFrame, lat: str = "gps_lat", lon: str = "gps_lon") -> DataFrame:
    """``df`` with ``city``, ``landmark``, ``location_name`` and ``confidence``: the nearest landmark in its radius (95), else city in its radius (85), else city within 120 km (70), else the coordinates (60); nulls without coordinates. Ties go to the earlier place."""
    cells = F.broadcast(place_cells(df.sparkSession))
    out = df.withColumns({"cell_lat": F.floor(lat), "cell_lon": F.floor(lon)}).join(cells, ["cell_lat", "cell_lon"], "left").drop("cell_lat", "cell_lon")
    near = F.transform("places", lambda p: F.struct(haversine_m(F.col(lat), F.col(lon), p["lat"], p["lon"]).alias("m"), p["order"].alias("order"), p["kind"].alias("kind"), p["radius"].alias("radius"), p["name"].alias("name"), p["city"].alias("city")))
    out = out.withColumn("_near", near).drop("places")
    mark = F.array_min(F.filter("_near", lambda p: (p["kind"] == 0) & (p["m"] <= p["radius"])))
    city = F.array_min(F.filter("_near", lambda p: (p["kind"] == 1) & (p["m"] <= p["radius"])))
    wide = F.array_min(F.filter("_near", lambda p: (p["kind"] == 1) & (p["m"] <= NEAR_M)))
    out = out.withColumns({"_mark": mark, "_city": city, "_wide": wide})
    label = gps_label(F.col(lat), F.col(lon))
    town = F.coalesce(F.col("_mark.city"), F.col("_city.city"), F.col("_wide.city"), label)
    located = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    score = F.when(~located, F.lit(None)).when(F.col("_mark").isNotNull(), 95).when(F.col("_city").isNotNull(), 85).when(F.col("_wide").isNotNull(), 70).otherwise(60)
    name = F.when(F.col("_mark").isNotNull(), F.concat(F.col("_mark.city"), F.lit(" • "), F.col("_mark.name"))).otherwise(town)
    return out.withColumns({"city": F.when(located, town), "landmark": F.col("_mark.name"), "location_name": F.when(located, name), "confidence": score}).drop("_near", "_mark", "_city", "_wide")


def _word(words: Sequence[str]) -> str:
    return r"\b(" + "|".join(w.replace(".", r"\.") for w in words) + r")\b"


def place_from_text(text: Column) -> Column:
    """``struct(city, landmark, confidence)`` of the first landmark that a text names as a whole word (90), else the first city beside a travel word (75); null if neither."""

    def found(low: Column) -> Column:
        # a pattern is only tried on a text that holds one of its words
        named = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]) & low.rlike(_word(words))
        place = lambda p, mark: F.struct(F.lit(p.city).alias("city"), F.lit(p.name if mark else None).cast("string").alias("landmark"), F.lit(90 if mark else 75).alias("confidence"))
        marks = F.coalesce(*[F.when(named(p.keywords), place(p, True)) for p in LANDMARKS])
        towns = F.coalesce(*[F.when(named([p.name.lower()]), place(p, False)) for p in CITIES])
        return F.coalesce(marks, F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in CLUES]), towns))

    every = F.get(F.transform(F.array(F.lower(text)), found), F.lit(0))  # the lower case is made once
    return F.when(F.length(F.trim(text)) >= 4, every)

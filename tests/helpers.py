import math


def tracks(spark, data, powers=None, times=None):
    """Vectors of {key: [vec, ...]} in order of keys as given."""
    rows = []
    for t, (key, vecs) in enumerate(data.items()):
        for i, v in enumerate(vecs):
            rows.append((t, key, i, [float(x) for x in v], None if powers is None else float(powers[key][i]), None if times is None else float(times[key][i][0]), None if times is None else float(times[key][i][1])))
    return spark.createDataFrame(rows, "track_id int, key string, pos int, vec array<double>, power double, t_start double, t_end double")


def datum(spark, vecs, powers=None, times=None, key=None):
    rows = [(key, i, [float(x) for x in v], None if powers is None else float(powers[i]), None if times is None else float(times[i][0]), None if times is None else float(times[i][1])) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "key string, pos int, vec array<double>, power double, t_start double, t_end double")


def points(found):
    return sorted((r.ikey, round(r.dist, 4) + 0.0, r.qpos, r.ipos) for r in found.collect())


def kl(a, b):
    def one(x, y):
        if y == 0:
            return math.inf if x > 0 else 0.0
        return x * math.log(x / y) if x / y > 0 else 0.0

    return sum((one(x, y) + one(y, x)) / 2 for x, y in zip(a, b, strict=True))

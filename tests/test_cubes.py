"""The engine's behaviour on small arrays, against numpy or fixed results."""

import datetime

import numpy as np
import pytest

from pyspark.sql import functions as F
from sparkcube.axes import Axis, AxisError, AxisKind, IntervalLabel, find_axis
from sparkcube.config import parse_bytes
from sparkcube.cube import SUBSET_HOOKS, Cube, Dataset, from_array, from_axis
from sparkcube.functions import nulls
from sparkcube.operators import align, combine, group, reduce, resample, select, slices, window
from sparkcube.operators.select import At, Contains, Interval, Near, Touches, Where
from sparkcube.sources import cf, store, zarr
from sparkcube.streaming import stats


@pytest.fixture(scope="module")
def small(spark):
    """4 x 5, first axis fastest: value at (x, y) is x + 4 (y - 1)."""
    return from_array(spark, np.arange(1, 21).reshape(5, 4).T.astype(float), [Axis("XVals", [1.0, 2.0, 3.0, 4.0]), Axis("YVals", [1, 2, 3, 4, 5])], {"long_name": "test", "units": "m"})


@pytest.fixture(scope="module")
def holes(spark):
    m = np.zeros((4, 2, 10), object)
    for i in range(10):
        m[:, 0, i], m[:, 1, i] = i + 1, 2 * (i + 1)
    m[3, 0, :] = 10
    m[0, 0, 2] = None
    for i in range(5, 10):
        m[2, 0, i] = None
    return from_array(spark, np.ma.masked_array(m, mask=np.equal(m, None)), [Axis("X", range(1, 5)), Axis("Y", [1, 2]), Axis("time", range(1, 11))])


def test_axes():
    axes = [Axis("longitude", [1, 2]), Axis("Variables", ["a"]), Axis("Ti", [1]), Axis("lat", [1.0, 1.25, 1.5])]
    assert find_axis(axes, "lon").name == "longitude" and find_axis(axes, "var").name == "Variables" and find_axis(axes, "time").name == "Ti"
    assert find_axis(axes, "nothing") is None
    assert axes[0].family is AxisKind.X and axes[3].step() == 0.25 and Axis("a", [1, 3, 4]).step() is None
    assert Axis("a", [5, 3, 1]).order() == "reverse" and Axis("a", [1, 3, 2]).order() == "unordered"
    with pytest.raises(AxisError):
        find_axis([Axis("lon", [1]), Axis("long", [1])], "lo")
    assert find_axis([Axis("lon", [1]), Axis("long", [1])], "lon").name == "lon"


def test_handle(spark, small):
    assert small.shape == (4, 5) and small.size == 20 and small.cubesize() == 160 and small.cast("float").cubesize() == 80
    assert small.label() == "test [m]" and small.isel(XVals=2, YVals=3).df.first()["value"] == 10
    with pytest.raises(AxisError):
        from_array(spark, np.zeros((2, 3)), [Axis("a", [1]), Axis("b", [1, 2, 3])])
    assert from_array(spark, np.zeros((2, 3))).dims == ("Dim_1", "Dim_2")
    assert from_axis(spark, small.XVals).to_numpy().tolist() == [1, 2, 3, 4]
    assert np.array_equal(small.permute("YVals", "XVals").to_numpy(), small.to_numpy().T)
    assert np.array_equal(small.permute("YVals", "XVals").permute("XVals", "YVals").to_numpy(), small.to_numpy())
    assert small.rename({"XVals": Axis("q", list("abcd"))}).sel(q="c", YVals=1).df.first()["value"] == 3
    assert "4" in repr(small)


def test_selectors(small, spark):
    a = small.to_numpy()
    assert np.array_equal(small.sel(xv=At([3.0, 1.0])).to_numpy(), a[[2, 0]])
    assert np.array_equal(small.sel(XVals=Near(2.2)).to_numpy(), a[1]) and np.array_equal(small.sel(YVals=slice(2, 4)).to_numpy(), a[:, 1:4])
    assert np.array_equal(small.sel(YVals=Interval(2, 4, "right")).to_numpy(), a[:, 2:4])
    assert np.array_equal(small.sel(YVals=Where(lambda y: y % 2)).to_numpy(), a[:, ::2])
    assert np.array_equal(small.isel(XVals=[4, 2], YVals=range(1, 3)).to_numpy(), a[[3, 1]][:, :2])
    for bad in ({"XVals": At(9.0)}, {"nothing": 1}, {"XVals": At(2.5, atol=0.1)}):
        with pytest.raises(AxisError):
            small.sel(**bad)
    with pytest.raises(AxisError):
        small.isel(XVals=5)
    spans = Axis("p", [IntervalLabel(0, 2), IntervalLabel(2, 4), IntervalLabel(4, 6)])
    c = from_array(spark, np.array([1.0, 2.0, 3.0]), [spans])
    assert c.sel(p=Touches(2, 3)).df.count() == 2 and c.sel(p=Contains(2)).df.first()["value"] == 2.0
    SUBSET_HOOKS.append(lambda cube, by: {("XVals" if k == "alias" else k): v for k, v in by.items()})
    try:
        assert small.sel(alias=2.0).df.count() == 5
    finally:
        SUBSET_HOOKS.pop()
    plan = small.sel(XVals=2.0).df._jdf.queryExecution().optimizedPlan().toString()
    assert "2.0" in plan


def test_points(spark):
    lon, lat = np.arange(30, 35.25, 0.25), np.arange(50, 55.25, 0.25)
    data = np.random.default_rng(1).random((len(lon), len(lat), 3))
    c = from_array(spark, data, [Axis("lon", lon.tolist()), Axis("lat", lat.tolist()), Axis("time", [1, 2, 3])])
    rng = np.random.default_rng(2)
    pts = [(float(30 + 5 * rng.random()), float(50 + 5 * rng.random()), f"s{i:03d}") for i in range(40)]
    got = select.extract_points(c, spark.createDataFrame(pts, "lon double, lat double, site string"), "site")
    want = np.array([data[np.abs(lon - x).argmin(), np.abs(lat - y).argmin()] for x, y, _ in pts])
    assert got.dims == ("site", "time") and np.allclose(got.to_numpy(), want)
    assert select.extract_points(c, spark.createDataFrame(pts, "lon double, lat double, s string").drop("s")).dims[0] == "lon_lat"


def test_alignment(spark):
    rng = np.random.default_rng(0)
    x, y, z = Axis("X", range(1, 5)), Axis("Y", range(1, 6)), Axis("Z", range(1, 7))
    a1, a2, a3 = rng.random((4, 5, 6)), rng.random((4, 6, 5)), rng.random((4, 5))
    c1, c2, c3 = from_array(spark, a1, [x, y, z]), from_array(spark, a2, [x, z, y]), from_array(spark, a3, [x, y])
    assert np.allclose((c1 + c2).to_numpy(), a1 + a2.transpose(0, 2, 1)) and np.allclose((c1 - c3).to_numpy(), a1 - a3[:, :, None])
    assert np.allclose((2 - c3 * 3).to_numpy(), 2 - a3 * 3)
    with pytest.raises(AxisError):
        c1 + from_array(spark, np.ones(4), [Axis("X", [9, 8, 7, 6])])
    outer = from_axis(spark, x) * from_axis(spark, y)
    assert np.allclose(outer.to_numpy(), np.outer(range(1, 5), range(1, 6)))
    with pytest.raises(AxisError):
        align.zip_map(lambda a, b: a + b, c1, combine.set_chunks(c1, {"X": 2}))
    zero = from_array(spark, np.array([[1.0, 0.0, -1.0]]))
    q = (zero / 0.0).to_df().orderBy("Dim_2").collect()
    assert q[0]["value"] == float("inf") and q[1]["value"] is not None and np.isnan(q[1]["value"]) and q[2]["value"] == float("-inf")
    nan = from_array(spark, np.array([1.0, np.nan]))
    assert [r["value"] for r in nan.map(F.isnan).df.orderBy("Dim_1").collect()] == [False, True]


def test_skip_filters(holes):
    total = lambda f: {(r["X"], r["Y"]): r["value"] for r in holes.reduce("sum", "time", filter=f).df.collect()}
    assert total(nulls.NO_FILTER)[1, 1] == 52
    assert total(nulls.ANY_MISSING)[1, 1] is None and total(nulls.ANY_MISSING)[2, 1] == 55
    assert total(nulls.n_valid(6))[3, 1] is None and total(nulls.n_valid(4))[3, 1] == 15
    assert total(nulls.STD_ZERO)[4, 1] is None
    assert total(nulls.user_filter(lambda v: F.bool_and(v % 2 == 0)))[1, 2] is None
    strict = {(r["X"], r["Y"]): r["value"] for r in holes.reduce("sum", "time", strict=True).df.collect()}
    assert strict[1, 1] is None and strict[1, 2] == 110
    got = slices.map_cube(lambda x: np.nansum(x), holes, indims=slices.InDims("time", filter=[nulls.ANY_MISSING, nulls.STD_ZERO]))
    assert {(r["X"], r["Y"]): r["value"] for r in got.df.collect()} == {(1, 2): 110, (2, 1): 55, (2, 2): 110, (3, 2): 110, (4, 2): 110}


def test_reductions(small, spark):
    assert reduce.mapslices("mean", small, "XVals").to_numpy().tolist() == [2.5, 6.5, 10.5, 14.5, 18.5]
    seven = np.arange(1, 1001).reshape(5, 20, 10).transpose(2, 1, 0).astype(float)
    c = from_array(spark, seven)
    assert np.allclose(reduce.mapslices("cumsum", c, "Dim_1").to_numpy(), seven.cumsum(axis=0))
    assert reduce.mapslices("sum", c, "Dim_2").to_numpy()[2, 2] == 9960
    kept = reduce.mapslices("sum", c, "Dim_2", dropdims=False)
    assert kept.shape == (1, 10, 5) and kept.dropdims("Dim_2").shape == (10, 5)
    assert c.reduce("sum").df.first()["value"] == c.reduce("sum", "Dim_1").reduce("sum").df.first()["value"] == 500500
    assert np.allclose(reduce.mapslices(lambda x, k: x.max() * k, c, "Dim_1", args=(2,)).to_numpy(), seven.max(axis=0) * 2)
    for how, f in (("std", lambda x: x.std(ddof=1)), ("median", np.median), ("max", np.max), ("prod", np.prod)):
        assert small.reduce(how).df.first()["value"] == pytest.approx(f(small.to_numpy()))


def test_windows(spark):
    rng = np.random.default_rng(3)
    data = rng.random((9, 5))
    data[4, 2] = np.nan
    c = from_array(spark, np.ma.masked_invalid(data), [Axis("lon", range(1, 10)), Axis("lat", range(1, 6))])
    back = window.shift(c, "lon", -1, -9999.0).to_numpy()
    assert np.allclose(back[1:], data[:-1], equal_nan=True) and (back[0] == -9999).all()
    off = window.offsets(c, "lon", 1, 1, -9999.0)
    assert off.shape == (9, 5, 3) and np.allclose(off.sel(offset=1).to_numpy()[:-1], data[1:], equal_nan=True)
    two = window.moving(c, "mean", lon=(1, 1), lat=(1, 1)).to_numpy()
    assert all(two[i, j] == pytest.approx(np.nanmean(data[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2])) for i in range(9) for j in range(5))
    assert np.allclose(window.moving(c, "sum", lon=(0, 0)).to_numpy(), data, equal_nan=True)
    part = window.moving_intervals(c, "lon", window.intervals(c.lon, right=[3, 9], width=3), "sum")
    assert part.lon.values == (2, 8) and np.allclose(part.to_numpy()[0], data[:3].sum(axis=0))
    assert window.intervals(c.lon, center=[3], width=2) == [IntervalLabel(2, 4, "right")]
    assert window.whole(c, "lon", "max").to_numpy().ravel() == pytest.approx(np.nanmax(data, axis=0))
    filled = window.fill_gaps(c, "lon").to_numpy()
    assert filled[4, 2] == pytest.approx((data[3, 2] + data[5, 2]) / 2)


def test_groups(spark, small):
    g = from_array(spark, np.array([1, 1, 3, 3]), [Axis("XVals", [1.0, 2.0, 3.0, 4.0])])
    a = small.to_numpy()
    got = group.group_by_cube(small, g, "sum", expected=[1, 2, 3])
    assert np.allclose(got.to_numpy(), [a[:2].sum(0), [np.nan] * 5, a[2:].sum(0)], equal_nan=True)
    assert np.allclose(group.group_labels(small, "YVals", lambda y: y // 3, "sum").to_numpy()[:, 0], a[:, :2].sum(1))
    assert np.allclose(group.group_labels(small, "YVals", group.bins([1, 3, 5]), "sum").to_numpy()[:, 1], a[:, 2:4].sum(1))
    cov = group.covariance(small, "XVals", "YVals").to_numpy()
    assert np.allclose(cov, np.cov(a))
    weighted = small.with_df(small.df.withColumn("w", F.col("YVals").cast("double")))
    assert np.allclose(group.covariance(weighted, "XVals", "YVals", F.col("w")).to_numpy(), np.cov(a, aweights=range(1, 6), bias=True))
    h = group.histogram(small, 30, "YVals")
    assert h.count() == 150 and h.agg(F.sum("Frequency")).first()[0] == 20
    ash = group.average_shifted_histogram(small, 10, 8, "YVals").collect()
    assert len(ash) == 40 and all(r["Frequency"] >= 0 for r in ash)
    assert group.counter(small.map(lambda v: v % 3), [0, 1, 2, 7]).to_numpy().tolist() == [6, 7, 7, 0]
    named = g.with_df(g.df, props={"labels": {1: "one", 2: "two", 3: "three"}, "name": "Class"})
    fit = group.fit_cubes({"v": small, "g": named}, "v", ["g", "YVals"], "sum")
    assert fit.dims == ("Class", "YVals") and np.allclose(fit.to_numpy(), [a[:2].sum(0), [np.nan] * 5, a[2:].sum(0)], equal_nan=True)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=31 * i) for i in range(24)]
    t = from_array(spark, np.arange(24.0), [Axis("time", days)])
    months = np.array([d.month for d in days])
    assert np.allclose(group.seasonal_cycle(t, "time").to_numpy(), [np.arange(24)[months == m].mean() for m in sorted(set(months))])
    assert abs(group.anomalies(t, "time").reduce("sum").df.first()["value"]) < 1e-9
    seasons = group.group_labels(t, "time", group.season("time"), "count", name="season").df.collect()
    assert {r["season"] for r in seasons} == set(group.SEASONS)


def test_slice_functions(spark):
    rng = np.random.default_rng(7)
    a, b = rng.random((4, 6)), rng.random((6, 3))
    x, t, k = Axis("x", range(1, 5)), Axis("t", range(1, 7)), Axis("k", range(1, 4))
    ca, cb = from_array(spark, a, [x, t]), from_array(spark, b, [t, k])
    dot = slices.map_cube(lambda u, v: u @ v, ca, cb, indims=(slices.InDims("t"), slices.InDims("t")))
    assert np.allclose(dot.permute("x", "k").to_numpy(), a @ b)
    wide = slices.map_cube(lambda u: np.stack([u, u * 2]), ca, indims=slices.InDims("t"), outdims=slices.OutDims(Axis("m", ["one", "two"]), "t"))
    assert wide.dims == ("m", "t", "x") and np.allclose(wide.sel(m="two").permute("x", "t").to_numpy(), a * 2)
    lo, hi = slices.map_cube(lambda u: (u.min(), u.max()), ca, indims=slices.InDims("t"), outdims=(slices.OutDims(), slices.OutDims()))
    assert np.allclose(lo.to_numpy(), a.min(1)) and np.allclose(hi.to_numpy(), a.max(1))
    ds = slices.map_cube(lambda d: d["p"].sum() - d["q"].sum(), Dataset({"p": ca, "q": ca * 2}), indims=slices.InDims("t"))
    assert np.allclose(ds.to_numpy(), -a.sum(1))
    assert np.allclose(slices.map_cube(lambda u, loop: loop["x"], ca, indims=slices.InDims("t"), include_loopvars=True).to_numpy(), [1, 2, 3, 4])
    assert np.allclose(slices.map_cube(lambda u: sum(u), ca, indims=slices.InDims("t", artype=list)).to_numpy(), a.sum(1))
    assert slices.map_cube(lambda u: u.sum(), ca, indims=slices.InDims("x", "t")).df.first()["value"] == pytest.approx(a.sum())
    names = slices.map_cube(lambda u: "big" if u.max() > 0.9 else "small", ca, indims=slices.InDims("t"), outdims=slices.OutDims(outtype="string"))
    assert {r["value"] for r in names.df.collect()} <= {"big", "small"}


def test_combining(small, spark):
    a = small.to_numpy()
    three = combine.concatenate({"A": small, "B": small * 2, "C": small * 3}, "Z")
    assert np.allclose(three.to_numpy(), np.stack([a, 2 * a, 3 * a], axis=2))
    with pytest.raises(AxisError):
        combine.concatenate([small, small.cast("int")], Axis("Z", [1, 2]))
    with pytest.raises(AxisError):
        combine.concatenate([small], Axis("Z", [1, 2]))
    parts = [small.sel(YVals=Interval(i, j)) for i, j in ((1, 2), (3, 5))]
    assert np.array_equal(combine.cat(parts, "YVals").to_numpy(), a)
    with pytest.raises(AxisError):
        combine.cat([small, small], "YVals")
    merged = combine.merge_datasets([Dataset({"v": parts[1]}), Dataset({"v": parts[0]})])
    assert merged["v"].YVals.values == (1, 2, 3, 4, 5) and np.array_equal(merged["v"].to_numpy(), a)
    with pytest.raises(AxisError):
        combine.merge_datasets([Dataset({"v": small}), Dataset({"v": small.sel(YVals=Interval(2, 3))})])
    ds = combine.to_dataset(three, "Z")
    assert list(ds.cubes) == ["A", "B", "C"] and np.allclose(combine.to_cube(ds, "Z").to_numpy(), three.to_numpy())
    mixed = Dataset({"i": small.cast("smallint"), "f": small})
    assert combine.to_cube(mixed).dtype == "double"
    with pytest.raises(AxisError):
        combine.promote(["string", "int"])
    assert ds[["A"]]["A"].shape == (4, 5) and ds.sel(XVals=2.0).cubes["B"].shape == (5,)
    with pytest.raises(KeyError):
        Dataset({"ab": small, "ac": small})["a"]


def test_resampling(spark):
    x, y = np.array([0.0, 1.0, 3.0]), np.array([0.0, 10.0])
    data = np.random.default_rng(5).random((3, 2))
    c = from_array(spark, data, [Axis("x", x.tolist()), Axis("y", y.tolist())])
    xs, ys = [0.5, 1.0, 2.5, 9.0], [2.5, 10.0]
    got = resample.resample(c, Axis("x", xs), Axis("y", ys)).to_numpy()
    along = np.array([[np.interp(p, x, data[:, j]) for j in range(2)] for p in xs[:3]])
    assert np.allclose(got[:3], [[np.interp(q, y, row) for q in ys] for row in along]) and np.isnan(got[3]).all()
    near = resample.resample(c, Axis("x", [0.4, 2.2]), method="nearest").to_numpy()
    assert np.allclose(near, data[[0, 2]])
    holed = c.update((F.col("x") == 1.0), None)
    assert np.isnan(resample.resample(holed, Axis("x", [0.5, 3.0])).to_numpy()[0]).all()


def test_store(spark, small, tmp_path):
    path = str(tmp_path / "a")
    span = from_array(spark, np.array([1.0, 2.0]), [Axis("p", [IntervalLabel(datetime.date(2020, 1, 1), datetime.date(2020, 2, 1)), IntervalLabel(datetime.date(2020, 2, 1), datetime.date(2020, 3, 1))])])
    ds = store.save_dataset(Dataset({"v": combine.set_chunks(small, (2, 5)), "span": span}, {"title": "t"}), path)
    assert ds.props == {"title": "t"} and ds["v"].chunks == {"XVals": 2, "YVals": 5} and ds["v"].props == small.props
    assert np.array_equal(ds["v"].to_numpy(), small.to_numpy()) and ds["span"].p.values == span.p.values
    with pytest.raises(FileExistsError):
        store.save_dataset(Dataset({"v": small}), path)
    with pytest.raises(ValueError):
        store.save_dataset(Dataset({"v": small}), path, append=True)
    with pytest.raises(AxisError):
        store.save_dataset(Dataset({"w": small.sel(XVals=Interval(1, 2))}), path, append=True)
    more = store.save_dataset(Dataset({"w": small * 2}), path, append=True)
    assert set(more.cubes) == {"v", "span", "w"}
    bare = store.save_dataset(Dataset({"s": small}), str(tmp_path / "b"), skeleton=True)
    assert bare["s"].shape == (4, 5) and np.isnan(bare["s"].to_numpy()).all()
    assert set(store.save_dataset(Dataset({"only": small}), path, overwrite=True).cubes) == {"only"}
    with pytest.raises(ValueError):
        store.open_dataset(spark, path, skip_keys=["only"])
    for i, (lo, hi) in enumerate(((1, 2), (3, 5))):
        store.save_dataset(Dataset({"v": small.sel(YVals=Interval(lo, hi))}), str(tmp_path / f"m{i}"))
    assert np.array_equal(store.open_mf_dataset(spark, str(tmp_path / "m*"))["v"].to_numpy(), small.to_numpy())
    c = store.save_cube(combine.concatenate({"a": small, "b": small}, "Variables"), str(tmp_path / "c"))
    assert c.shape == (4, 5, 2)
    with pytest.raises(NotImplementedError):
        store.open_dataset(spark, "x.nc")


def test_zarr(spark, tmp_path):
    path = str(tmp_path / "s.zarr")
    data = np.arange(120, dtype=float).reshape(12, 5, 2)
    data[3, 1, 1] = np.nan
    zarr.write_array(f"{path}/v", data, (5, 5, 1), ("time", "lat", "band"), {"units": "K", "scale_factor": 2.0, "add_offset": 1.0})
    zarr.write_array(f"{path}/time", np.arange(12), (12,), ("time",), {"units": "days since 2001-01-01", "_ARRAY_OFFSET": 2})
    zarr.write_array(f"{path}/lat", np.linspace(0.1, 0.5, 5), (5,), ("lat",))
    zarr.write_array(f"{path}/lat_bnds", np.zeros((5, 2)), (5, 2), ("lat", "band"))
    zarr.write_array(f"{path}/band", np.array([1, 2]), (2,), ("band",), {"_ARRAYVALUES": ["One", "Two"]})
    ds = store.open_dataset(spark, path)
    assert list(ds.cubes) == ["v"] and ds["v"].shape == (10, 5, 2)
    assert ds["v"].time.values[0] == datetime.date(2001, 1, 3) and ds["v"].band.values == ("One", "Two")
    assert np.allclose(ds["v"].to_numpy(), data[2:] * 2 + 1, equal_nan=True)
    assert ds["v"].df.rdd.getNumPartitions() == 6
    again = zarr.save_zarr(Dataset({"v": combine.set_chunks(ds["v"], {"time": 4, "lat": 2}), "n": ds["v"].cast("int")}), str(tmp_path / "t.zarr"))
    assert np.allclose(again["v"].to_numpy(), data[2:] * 2 + 1, equal_nan=True) and again["v"].time.values == ds["v"].time.values
    assert again["v"].chunks == {"time": 4, "lat": 2, "band": 1} and again["v"].props == {"units": "K"}
    assert again["n"].df.count() == 99


def test_cf(spark):
    assert cf.decode_times([0, 1.5], "hours since 2000-01-01") == [datetime.datetime(2000, 1, 1), datetime.datetime(2000, 1, 1, 1, 30)]
    assert cf.decode_times([59], "days since 2001-01-01", "360_day") == [cf.CFDate(2001, 2, 30)]
    assert cf.decode_times([365], "days since 2000-01-01", "noleap") == [cf.CFDate(2001, 1, 1)]
    months = Axis("time", cf.decode_times(range(0, 360, 30), cf.ORIGIN, "360_day"))
    c = from_array(spark, np.arange(12.0), [months])
    assert c.sel(time=cf.CFDate(1980, 3, 1)).df.first()["value"] == 2 and np.array_equal(c.sel(time=Interval(cf.CFDate(1980, 3, 1), cf.CFDate(1980, 5, 1))).to_numpy(), [2, 3, 4])
    for cal in ("noleap", "all_leap", "360_day"):
        days = cf.decode_times(range(0, 2000, 7), cf.ORIGIN, cal)
        assert cf.encode_times(days, cal) == list(range(0, 2000, 7))
    assert cf.encode_times([datetime.date(1980, 1, 11)]) == [10]
    with pytest.raises(ValueError):
        cf.decode_times([1], "meters")
    assert parse_bytes("2GB") == 2e9 and parse_bytes(5) == 5
    with pytest.raises(ValueError):
        parse_bytes("2TB")


def test_streaming(spark, tmp_path):
    t = spark.createDataFrame([(datetime.datetime(2024, 1, 1, h, m), h % 2, float(m)) for h in range(4) for m in range(0, 60, 7)], "ts timestamp, k int, v double")
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    want = stats.windowed(t, "ts", "1 hour", {"k": F.col("k")}, {"n": ("count", "v"), "m": ("mean", "v")})
    out = stats.windowed(stream, "ts", "1 hour", {"k": F.col("k")}, {"n": ("count", "v"), "m": ("mean", "v")})
    q = out.writeStream.outputMode("complete").format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("kept").collect()) == sorted(want.collect()) and want.count() == 4
    assert stats.sessions(t, "ts", "10 minutes", "k", "v").count() >= 2


def test_statistics_merge(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v")).repartition(7)
    got = slices.partials(df, ["k"], "v", lambda s, x: (len(x), x.sum()), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[1] / s[0])
    assert {r["k"]: r["value"] for r in got.collect()} == {k: pytest.approx(np.arange(k, 1000, 3).mean()) for k in range(3)}


def test_cumulation_follows_positions(spark):
    """Descending and unordered axes: the running sum goes by position, not by label."""
    for labels in ([90, 0, -90], ["b", "c", "a"], [1, 2, 3]):
        c = from_array(spark, np.array([1.0, 2.0, 3.0]), [Axis("lat", labels)])
        assert reduce.mapslices("cumsum", c, "lat").to_numpy().tolist() == [1, 3, 6]


def test_overwriting_what_is_read(spark, small, tmp_path):
    path = str(tmp_path / "own")
    ds = store.save_dataset(Dataset({"v": small}), path)
    again = store.save_dataset(Dataset({"v": ds["v"].map(lambda v: v + 1)}), path, overwrite=True)
    assert np.array_equal(again["v"].to_numpy(), small.to_numpy() + 1)
    assert np.array_equal(store.open_dataset(spark, path)["v"].to_numpy(), small.to_numpy() + 1)
    assert len([p for p in (tmp_path / "own").iterdir() if p.is_dir()]) == 1
    with pytest.raises(NotImplementedError):
        store.open_dataset(spark, str(tmp_path / "x.nc"))


def test_where_of_an_axis_shortens_it(small):
    kept = small.sel(XVals=Where(F.col("XVals") > 2))
    assert kept.shape == (2, 5) and kept.reduce("sum", "XVals", strict=True).to_numpy().tolist() == small.to_numpy()[2:].sum(axis=0).tolist()
    masked = small.sel(XVals=Where(F.col("value") > 4))
    assert masked.shape == (4, 5) and np.isnan(masked.to_numpy()[0, 0])


def test_merging_equal_axes_is_an_error(small):
    with pytest.raises(AxisError, match="fill"):
        combine.merge_datasets([Dataset({"v": small}), Dataset({"v": small.map(lambda v: -v)})])


def test_mapslices_of_functions(small, spark):
    x = small.to_numpy()
    assert np.array_equal(reduce.mapslices(lambda s: s, small, "YVals").permute("X", "Y").to_numpy(), x)
    assert np.array_equal(reduce.mapslices(lambda s: s[::-1], small, "XVals", "YVals").to_numpy(), x[::-1])
    ends = reduce.mapslices(lambda s, k: np.array([s[0], s[-1]]) * k, small, "YVals", args=(2,))
    assert ends.dims == ("OutAxis1", "XVals") and np.array_equal(ends.to_numpy(), 2 * x[:, [0, -1]].T)
    assert np.array_equal(reduce.mapslices(np.max, small, "YVals").to_numpy(), x.max(axis=1))
    text = slices.map_cube(lambda s: "big" if s.sum() > 50 else None, small, indims=slices.InDims("YVals"), outdims=slices.OutDims(outtype="string"))
    assert text.to_numpy().tolist() == ["big" if s > 50 else None for s in x.sum(axis=1)]


def test_moving_windows_of_slices(small):
    """Windows of a loop axis with a whole axis beside them: 3 x 5 cells a call, those beyond the axis as given."""
    x = small.to_numpy()
    seen = slices.map_cube(lambda s: float(s.sum()) if s.shape == (5, 3) else np.nan, small, indims=slices.InDims("YVals", window={"XVals": (1, 1)}, oob=100.0))
    padded = np.vstack([np.full((1, 5), 100.0), x, np.full((1, 5), 100.0)])
    assert seen.to_numpy().tolist() == [padded[i : i + 3].sum() for i in range(4)]


def test_principal_components(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 1))
    one, two = np.hstack([base, 2 * base, -base]), np.hstack([base, rng.normal(size=(40, 1)), base])
    cube = from_array(spark, np.stack([one, two], axis=2), [Axis("time", range(40)), Axis("var", ["a", "b", "c"]), Axis("pixel", [1, 2])])
    assert slices.pca_dims(cube, "var", "time", 0.95).to_numpy().tolist() == [1, 2]

"""Operators over pixel tables: several images, tiles, partitions, sources, experiments, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismgrid.functions import kernels
from prismgrid.functions.metrics import psnr
from prismgrid.model import Border, Cluster, FilterSpec, Sampler, Signal, Smoother
from prismgrid.operators import border, channels, cluster, exact, pca, resample, sampling
from prismgrid.operators.approximate import cluster_filter, halo_of, kd_tree_filter, lattice_filter
from prismgrid.operators.spatial import gaussian
from prismgrid.operators.tiling import divided, from_tiles, to_tiles
from prismgrid.plans import cli, experiment, methods
from prismgrid.sources import images, scenes
from prismgrid.streaming.frames import SCHEMA, filter_tiles

RNG = np.random.default_rng(5)


def raster(spark, *pictures, guides=None):
    rows = []
    for i, p in enumerate(pictures):
        g = p if guides is None else guides[i]
        rows += [(i, y, x, p[y, x].tolist(), g[y, x].tolist()) for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "img_id int, y int, x int, f array<double>, g array<double>")


def image(df, img=0, column="f"):
    rows = df.where(F.col("img_id") == img).orderBy("y", "x").select("y", "x", column).collect()
    return np.array([r[2] for r in rows]).reshape(rows[-1].y + 1, rows[-1].x + 1, -1)


@pytest.fixture(scope="module")
def two(spark):
    a, b = RNG.random((20, 24, 3)) * 255, RNG.random((9, 11, 3)) * 255
    return a, b, raster(spark, a, b).persist()


@pytest.mark.parametrize("kind", list(Border))
def test_tiles_equal_the_whole_image(two, kind):
    a, b, px = two
    for p, i in ((a, 0), (b, 1)):
        q = kernels.padded(p, 4, kind)
        inside = kernels.padded(np.ones((*p.shape[:2], 1)), 4, kind)[:, :, 0] if kind == Border.CONSTANT else None
        want = kernels.hdgf(q, q, 4, 2.0, 60.0, inside)
        for how in ({"tile": (7, 5)}, {"divisions": (4, 3)}, {}):
            got = exact.hdgf(px, sigma_space=2.0, sigma_range=60.0, radius=4, border=kind, **how)
            assert np.allclose(image(got, i), want)


def test_partitions_do_not_matter(two):
    _, _, px = two
    spec = FilterSpec(divisions=(2, 2), sigma_space=1.5)
    for run in (cluster_filter, lattice_filter, kd_tree_filter):
        assert np.allclose(image(run(px, spec)), image(run(px.repartition(7), spec)))


def test_join_plan(two):
    _, b, px = two
    args = {"sigma_space": 2.0, "sigma_range": 60.0, "radius": 2}
    for kind in Border:
        assert np.allclose(image(exact.hdgf(px, plan="join", border=kind, **args), 1), image(exact.hdgf(px, border=kind, **args), 1))


def test_tile_pca_with_all_channels_is_exact(two):
    _, _, px = two
    args = {"sigma_space": 2.0, "sigma_range": 60.0, "radius": 4}
    assert np.allclose(image(exact.hdgf_tile_pca(px, pca_dim=3, divisions=(2, 2), **args)), image(exact.hdgf(px, **args)))


def test_incomplete_images_raise(spark, two):
    _, _, px = two
    holes = px.where("not (img_id = 0 and y = 3 and x = 3)")
    with pytest.raises(ValueError):
        border.check_dense(holes)
    with pytest.raises(Exception, match="full rectangle"):
        gaussian(holes, sigma_space=1.0).collect()
    border.check_dense(px)
    with pytest.raises(ValueError):
        divided((10, 10), (3, 1))
    assert divided((10, 12), (5, 3)) == (2, 4)


def test_empty_table(spark):
    px = spark.createDataFrame([], "img_id int, y int, x int, f array<double>, g array<double>")
    assert not exact.hdgf(px, sigma_space=1.0, sigma_range=10.0).count()
    assert not gaussian(px, sigma_space=1.0).count()
    assert not pca.project(px, 1).count()


def test_smoothers(two):
    _, _, px = two
    fir, slide = (image(gaussian(px, sigma_space=2.0, how=h, order=5, tile=(6, 9))) for h in (Smoother.FIR, Smoother.SLIDING_COSINE))
    assert np.abs(fir - slide).max() < 1


def test_pca_of_images(two):
    a, b, px = two
    for p, i in ((a, 0), (b, 1)):
        _, basis, value = kernels.principal(p.reshape(-1, 3), 2)
        assert np.allclose(image(pca.project(px, 2), i, "g"), p @ basis)
        assert np.allclose(pca.fit(px, 2).where(f"img_id = {i}").first().eigenvalues, value)
    assert pca.reconstruction_psnr(px, 3).agg(F.min("psnr_db")).first()[0] > 200


def test_patches_and_tiles_of_patches(two):
    a, _, px = two
    from prismgrid.operators.patches import im2col

    want = kernels.im2col(kernels.padded(a, 1, Border.REFLECT101), 1)
    assert np.allclose(image(im2col(px, 1), 0, "g"), want)
    assert image(pca.patch_pca_tiles(px, 1, 4, halo=3, divisions=(2, 2))).shape == (20, 24, 4)


def test_resampling(two):
    a, _, px = two
    one = px.where("img_id = 0")
    assert np.allclose(image(resample.resize_area(one, 10, 12)), a.reshape(10, 2, 12, 2, 3).mean((1, 3)))
    assert np.allclose(image(resample.resize_area(one, 20, 24)), a)
    big = image(resample.resize_area(one, 30, 36))
    assert big.shape == (30, 36, 3) and np.isclose(big.mean(), a.mean())
    assert np.allclose(image(resample.resize_nearest(one, 10, 36)), a[np.arange(10) * 2][:, np.arange(36) * 24 // 36])


def test_occlusion(spark):
    p = np.array([[0, 5, 0, 0, 3, 0], [0, 0, 0, 0, 0, 0]], float)[:, :, None]
    got = image(resample.fill_occlusion(raster(spark, p), F.get("f", 0) == 0))[:, :, 0]
    assert got.tolist() == [[5, 5, 3, 3, 3, 3], [0] * 6]


def test_noise_and_signals(spark, two):
    a, _, px = two
    noisy = image(channels.add_noise(px, 15.0, seed=2)) - a
    assert abs(noisy.mean()) < 1.5 and abs(noisy.std() - 15) < 1.5
    assert np.allclose(noisy, image(channels.add_noise(px.repartition(5), 15.0, seed=2)) - a)
    one = px.where("img_id = 0")
    ir = one.select("img_id", "y", "x", F.slice("f", 1, 1).alias("f"))
    sizes = {k: (len(r.f), len(r.g)) for k, r in ((k, channels.guided(one, ir if k in (Signal.RGBIR, Signal.RGBD) else one, k).first()) for k in Signal)}
    assert sizes == {Signal.RGB: (3, 3), Signal.RGBIR: (3, 4), Signal.RGBD: (1, 4), Signal.FNF: (3, 6), Signal.HSI: (3, 3), Signal.NLM: (3, 27)}


def test_samplers(two):
    _, _, px = two
    n = px.count()
    assert sampling.gradient_max(px, 0.25).count() == 10 * 12 + 5 * 6
    assert sampling.stride(px, 0.25).count() == 10 * 12 + 5 * 6
    for rows in (sampling.importance(px, 0.25), sampling.dither(px, 0.25), sampling.dither(px, 0.25, by_dog=True, sigma=1.0)):
        assert 0.1 * n < rows.count() < 0.4 * n and rows.columns == px.columns


@pytest.mark.parametrize("method", [c for c in Cluster if c != Cluster.X_MEANS])
def test_table_clusters(spark, method):
    x = np.concatenate([RNG.normal(c, 2, (30, 2)) for c in ((0, 0), (100, 0), (0, 100), (100, 100))]).reshape(10, 12, 2)
    px = raster(spark, x).persist()
    mu = cluster.fit(px, method, 4, 5)
    assert 1 <= len(mu) <= 4
    if method not in (Cluster.RANDOM_SAMPLE, Cluster.KMEANS):
        assert cluster.cost(px, mu) / 120 < 200


@pytest.mark.parametrize("code", sorted(methods.METHODS))
@pytest.mark.parametrize("nlm", [False, True])
def test_methods(two, code, nlm):
    a, _, px = two
    spec = FilterSpec(divisions=(2, 2), sigma_space=1.5, sigma_range=80, k=6)
    got = image(methods.run_method(code, px.where("img_id = 0"), spec, nlm))
    assert got.shape == a.shape and np.isfinite(got).all()
    if code == -1:
        assert np.allclose(got, a)


@pytest.mark.parametrize("kind", range(4))
@pytest.mark.parametrize("reduction", range(3))
@pytest.mark.parametrize("patch", [0, 1])
def test_cells(two, kind, reduction, patch):
    _, b, px = two
    spec = FilterSpec(divisions=(1, 1), sigma_space=1.0, sigma_range=80, k=4)
    got = image(methods.run_cell(kind, reduction, patch, px.where("img_id = 1"), spec), 1)
    assert got.shape == b.shape and np.isfinite(got).all()


def test_wrong_names(two):
    with pytest.raises(ValueError):
        methods.run_method(9, two[2], FilterSpec())
    with pytest.raises(ValueError):
        methods.run_cell(4, 0, 0, two[2], FilterSpec())
    assert halo_of(1.0, 2.5) == 3


def test_sweep_and_gain(spark):
    y, x = np.mgrid[:16, :16]
    px = raster(spark, np.stack([x * 9.0, y * 9.0, (x > 8) * 200.0], 2) + RNG.normal(0, 5, (16, 16, 3))).persist()
    spec = FilterSpec(divisions=(1, 1), sigma_space=1.5, sigma_range=40, cluster=Cluster.KMEANS_PP_FAST, sampler=Sampler.NEAREST)
    plain = experiment.sweep(px, [0], spec, {"k": [2, 6]}, repeats=2, warmup=0)
    weighted = experiment.sweep(px, [0], spec.but(cluster=Cluster.GAUSS_INV_MEANS_PP), {"k": [2, 6]}, repeats=2, warmup=0)
    assert plain.count() == 4
    out = {r.method: r for r in experiment.gain(plain.unionByName(weighted), {"cluster": "kmeans_pp_fast"}, ["k"]).collect()}
    assert out[0].gain_db is not None
    assert [int(line.split(",")[0]) for line in experiment.report(plain)] == [2, 6]


def test_images_round_trip(spark, tmp_path):
    a = RNG.integers(0, 256, (12, 10, 3)).astype(float)
    px = raster(spark, a)
    images.save_png(px, str(tmp_path), "pic_{}.png")
    back = images.read_images(spark, str(tmp_path / "pic_0.png"))
    assert np.allclose(image(back), a)
    gray = images.read_images(spark, str(tmp_path / "pic_0.png"), gray=True)
    assert np.allclose(image(gray)[:, :, 0], a @ np.array(images.LUMA))
    (tmp_path / "bad_1.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="no image"):
        images.read_images(spark, str(tmp_path / "bad_1.png")).collect()
    images.write_dataset(px, str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set")).count() == 120


def test_scenes(spark, tmp_path):
    for i in range(2):
        for kind in ("rgb", "ir", "flash"):
            images.save_png(raster(spark, RNG.integers(0, 256, (16, 16, 3)).astype(float)), str(tmp_path), f"{kind}_{i}.png")
        for b in range(1, 4):
            images.save_png(raster(spark, np.full((32, 40, 1), 10.0 * b + i)), str(tmp_path), f"band_{i}_{b}.png")
    at = f"{tmp_path}/"
    assert len(scenes.colour_infrared(spark, at + "rgb_{}.png", at + "ir_{}.png", range(2)).first().g) == 4
    assert len(scenes.flash_pairs(spark, at + "flash_{}.png", at + "rgb_{}.png", range(2)).first().g) == 6
    depth = scenes.colour_depth(spark, at + "rgb_{}.png", at + "ir_{}.png", range(2), scale=2.0).first()
    assert (len(depth.f), len(depth.g)) == (1, 4) and depth.f[0] * 2 == depth.g[3]
    cube = scenes.bands(spark, at + "band_{}_{}.png", range(2), 3)
    assert cube.where("img_id = 1").first().f == [11.0, 21.0, 31.0]
    full = scenes.prepare_bands(cube, (32, 40), 5, 8)
    assert image(full).shape == (8, 8, 5) and full.where("img_id = 0").first().f[4] == 30.0
    rgb = scenes.colour(spark, at + "rgb_{}.png", ["0", "1"], (16, 16), 2)
    assert image(rgb).shape == (16, 16, 3)
    assert image(scenes.square(cube, 4)).shape == (4, 4, 3)
    c, d = scenes.prepare_depth(rgb, cube.withColumn("f", F.slice("f", 1, 1)), (8, 8), (1, 1, 4, 4))
    assert image(c).shape == (4, 4, 3) and image(d).shape[:2] == (4, 4)
    assert image(scenes.prepare_infrared(rgb, rgb, 8)[0]).shape == (8, 8, 3)


def test_command_line(spark, tmp_path):
    y, x = np.mgrid[:16, :16]
    images.save_png(raster(spark, np.stack([x * 9.0, y * 9.0, (x > 8) * 200.0], 2)), str(tmp_path), "in_{}.png")
    runs = cli.main([str(tmp_path / "in_0.png"), "--out", str(tmp_path), "--divisions", "2", "2", "--sigma-space", "1.5", "--iterations", "2", "--check"], spark)
    assert len(runs) == 2 and runs[0][0] > 25
    assert (tmp_path / "result_0.png").exists()


def test_stream_of_tiles(spark, two, tmp_path):
    a, _, px = two
    tiles = to_tiles(px, 4, tile=(7, 9))
    tiles.write.parquet(str(tmp_path / "in"))
    stream = filter_tiles(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), sigma_space=2.0, sigma_range=60.0)
    q = stream.writeStream.format("memory").queryName("tiles_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    got = from_tiles(spark.table("tiles_out"))
    assert np.allclose(image(got), image(exact.hdgf(px, sigma_space=2.0, sigma_range=60.0, radius=4)))


def test_psnr(two):
    _, _, px = two
    other = px.withColumn("f", F.transform("f", lambda v: v + 5))
    assert psnr(px, px).agg(F.min("psnr_db")).first()[0] == float("inf")
    assert np.isclose(psnr(px, other, crop=2).first().mse, 25)

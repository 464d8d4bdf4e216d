"""Where tables between stages go."""

import pytest

from freshet.session import shared_dir


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Session:
    """Only what shared_dir looks at."""

    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()


def test_the_cluster_names_the_folder():
    got = shared_dir(Session("yarn", **{"spark.checkpoint.dir": "hdfs://shared/"}), "x")
    assert got.startswith("hdfs://shared/freshet-app-yarn/x-")


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(ValueError):
        shared_dir(Session("yarn"), "x")


def test_a_local_session_makes_one_folder():
    session = Session("local[2]")
    first, second = shared_dir(session, "a"), shared_dir(session, "a")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_changed_input_is_staged_anew(spark, tmp_path):
    from freshet.session import run_dir
    from freshet.sources.stages import stage_once

    folder, built = str(tmp_path / "in"), []

    def build():
        built.append(1)
        return spark.read.parquet(f"{folder}/t.parquet")

    spark.range(3).write.parquet(f"{folder}/t.parquet")
    assert stage_once(spark, folder, "x", build).count() == 3 and stage_once(spark, folder, "x", build).count() == 3
    assert len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert stage_once(spark, folder, "x", build).count() == 5
    other = spark.newSession()
    assert run_dir(other) == run_dir(spark)


def test_release_removes_the_run_folder(tmp_path):
    from freshet.session import release

    removed = []

    class Path:
        def __init__(self, where):
            self.where = where

        def getFileSystem(self, _):
            return type("Files", (), {"delete": lambda _, path, deep: removed.append((path.where, deep))})()

    session = Session("yarn", **{"spark.checkpoint.dir": "hdfs://shared"})
    hadoop = type("N", (), {"Path": Path})
    session.sparkContext._jvm = type("J", (), {"org": type("O", (), {"apache": type("A", (), {"hadoop": type("H", (), {"fs": hadoop})})})})
    session.sparkContext._jsc = type("C", (), {"hadoopConfiguration": lambda self: None})()
    release(session)
    assert removed == [("hdfs://shared/freshet-app-yarn", True)]

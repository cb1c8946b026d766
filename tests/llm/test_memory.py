"""What a Python worker holds from one stage to the next."""

from credsieve.llm import common, language, near_duplicates, privacy


class Rows:
    """Stands for a frame: runs the task's function on no rows."""

    def mapInArrow(self, work, schema):
        list(work(iter([])))
        return self

    def groupBy(self, *columns):
        return self

    agg = groupBy


def test_stages_without_a_table_give_back_those_of_the_stage_before(spark):
    for stage in (
        lambda: language._counts(Rows()), lambda: language._gram_counts(Rows()), lambda: list(near_duplicates._sketch(iter([]))),
        lambda: list(privacy._scan(iter([]))), lambda: list(privacy._places(iter([]))),
    ):
        common.held_once("table of another stage", lambda: bytearray(10))
        stage()
        assert not common._held

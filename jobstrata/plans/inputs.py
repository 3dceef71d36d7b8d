"""What the report sections read: counted frames over one postings table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.config import DEFAULTS, FLAGS, Settings
from jobstrata.functions.text import tokens
from jobstrata.operators.aggregates import MEASURES, count_cube, roll_up
from jobstrata.streaming.files import written

BASE_KEYS = ("year", "source", "job_category", "seniority", "location_extracted")


class PostingCubes:
    """Counted frames by need.

    ``rows`` is a postings frame, or a function of the needed columns returning one, so a
    star-schema source joins only the dimensions a section uses.  ``shared()`` switches to
    one persisted base cube that all sections roll up from.  The company column stays out
    of the base cube: its many values would make the cube as large as the rows.
    """

    def __init__(self, rows, settings: Settings = DEFAULTS, order=("record_id",)):
        self._rows = rows if callable(rows) else (lambda columns: rows)
        self.settings = settings
        self.order = tuple(order)
        self._base = None
        self._held = {}
        self._kept = None
        self._sharing = False

    def rows(self, *columns) -> DataFrame:
        return self._rows(columns)

    def shared(self, *frames, folder: str = None) -> "PostingCubes":
        """Persist the frames several sections read: all of them, or those named of base, company and token.

        With a ``folder``, the tokens of all titles are saved in it first: taking them costs far more than reading them again.
        """
        makers = {"company": self._company, "token": self._tokens}
        self._sharing = True
        if folder:
            self._kept = written(self.title_tokens(), folder)
        frames = frames or ("base", *makers)
        if "base" in frames:
            self._base = count_cube(self.rows(*BASE_KEYS, "record_id", *FLAGS), *BASE_KEYS).persist()
        self._held = {name: make().persist() for name, make in makers.items() if name in frames}
        return self

    def release(self):
        for frame in [self._base, *self._held.values()]:
            if frame is not None:
                frame.unpersist()
        self._base, self._held, self._kept, self._sharing = None, {}, None, False

    def once(self, name: str, make) -> DataFrame:
        """A small frame of several sections, persisted while the frames are shared."""
        if not self._sharing:
            return make()
        if name not in self._held:
            self._held[name] = make().persist()
        return self._held[name]

    def cube(self, *keys) -> DataFrame:
        if self._base is not None:
            return roll_up(self._base, *keys)
        return count_cube(self.rows(*keys, "record_id", *FLAGS), *keys)

    def companies(self) -> DataFrame:
        """Counts by year and company."""
        return self._held.get("company") or self._company()

    def token_counts(self) -> DataFrame:
        """Occurrences of each title token by year."""
        return self._held.get("token") or self._tokens()

    def bigram_counts(self) -> DataFrame:
        return self.bigram_rows().groupBy("year", "bigram").agg(F.count(F.lit(1)).alias("n_rows"))

    def flag_cube(self) -> DataFrame:
        """Row counts of every combination of flags: at most 2^flags rows."""
        return self.rows(*FLAGS).groupBy(*FLAGS).agg(F.count(F.lit(1)).alias("n_rows"))

    def _company(self):
        keys = ("year", "company_extracted")
        return count_cube(self.rows(*keys, "record_id", *FLAGS), *keys)

    def title_tokens(self) -> DataFrame:
        """Year, order and the tokens of every title, in their order."""
        if self._kept is not None:
            return self._kept
        titles = self.rows("year", "title", *self.order).filter(F.col("title").isNotNull())
        return titles.select("year", *self.order, tokens(F.col("title"), self.settings.stopwords).alias("kept"))

    def _tokens(self):
        return self.title_tokens().select("year", F.explode("kept").alias("token")).groupBy("year", "token").agg(
            F.count(F.lit(1)).alias("n_rows")
        )

    def bigram_rows(self) -> DataFrame:
        """Every bigram of every title with its year, uncounted."""
        n = F.greatest(F.size("kept") - 1, F.lit(0))
        pairs = F.inline(F.arrays_zip(F.slice("kept", 1, n), F.slice("kept", 2, n))).alias("a", "b")
        return self.title_tokens().select("year", pairs).select("year", F.concat("a", F.lit(" "), "b").alias("bigram"))


__all__ = ["PostingCubes", "BASE_KEYS", "MEASURES"]

"""Constants, patterns, word lists and lookup tables.

Results are only right when these equal the published detector definitions, so they are kept
here together, as plain text. Patterns are written for Java regular expressions; ``(?U)``
makes ``\\w``, ``\\b`` and ``\\d`` Unicode-aware.
"""

# --- statistics --------------------------------------------------------------
MAD_SCALE = 1.4826
SCALE_FLOOR_SHARE = 0.02
PSI_FLOOR = 1e-4

# --- dates and status --------------------------------------------------------
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy h:m:s a", "M/d/yyyy", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s")
METHOD_STATUS = {"clean": "passed", "flagged": "review", "inconclusive": "inconclusive", "informational": "inconclusive"}
CLASSIFICATIONS = ("preserved", "expected change pending review", "new regression", "defect fixed", "still open", "inconclusive")
CLASSIFICATION_SEVERITY = ("new regression", "still open", "expected change pending review", "inconclusive", "defect fixed", "preserved")
CLAIM_STATUSES = ("passed", "failed", "inconclusive")
REVIEW_DECISIONS = ("accepted", "confirmed_defect", "unresolved", "exception")
COMPONENT_LABELS = {"problem": "Problem found", "decision": "Needs your decision", "ok": "Looks right"}
SEVERITY_RANK = {
    "critical": 0, "blocker": 0, "high": 1, "medium": 2, "moderate": 2, "low": 3, "minor": 3, "info": 4, "informational": 4, "review": 4}
UNRATED = 5
GROUP_RANK = {"defect": 0, "open": 1, "lint": 2, "passed": 3}
NUMBER_WORDS = ("no", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
GUARD_POINTERS = ("/verified_report_title", "/active_page", "/popup_open", "/calendar_open", "/edit_overlay_open")
NOTE_ABBREVIATED = "the card shows an abbreviated value; declare the exact figure through an oracle"
NOTE_UNREADABLE = "one of the figures could not be read as a number"
NOTE_ZERO_DIVIDER = "the figure it is divided by is zero"

# --- detector catalog: id, title, kind, domain, severity, implemented_as, claim ----
CATALOG = (
    ("lint.volatile_time_in_column", "Date flag driven by the clock", "lint", "time", "high", None,
     "Date flags derived from the clock reflect the imported data's completeness, not the machine date."),
    ("lint.volatile_time_in_measure", "Measure driven by the clock", "lint", "time", "medium", None,
     "Clock-dependent measures are documented as such and behave correctly on a stale import."),
    ("lint.date_context_removed", "Whole-period amount under a partial selection", "lint", "time", "medium", None,
     "Removing the date context is intended and a partial-period selection does not add whole-period amounts."),
    ("lint.raw_division", "Division without a zero guard", "lint", "ratios", "low", None,
     "Ratios return BLANK, not infinity or an error, on empty denominators."),
    ("lint.format_hides_precision", "Rounding hides precision", "lint", "presentation", "low", None,
     "Displayed precision does not hide changes the analyst cares about."),
    ("lint.multiple_relationship_paths", "Ambiguous attribution path", "lint", "attribution", "medium", None,
     "Each visual's attribution lens (first / last touch) matches its label."),
    ("lint.freshness_label_on_business_date", "Refresh label bound to a business date", "lint", "presentation", "medium", None,
     "Freshness labels report model refresh, not the latest selected business date."),
    ("lint.stale_query_name", "Header names a different measure", "lint", "presentation", "low", None,
     "Column headers and legends name the measure that is actually bound."),
    ("dax.fan_out", "Double counting through joins", "dax", "grain", "high", None,
     "Row counts and sums are unchanged by the relationship path, and business keys are unique at the declared grain."),
    ("dax.additivity", "Members do not add up to the total", "dax", "grain", "high", None,
     "Members of a breakdown sum to the displayed total for additive measures."),
    ("dax.assert", "Custom data rule", "dax", "generic", "medium", None, "The stated invariant holds in the imported population."),
    ("stat.ratio_of_totals_vs_mean_of_ratios", "Ratio total computed as an average", "stat", "ratios", "medium", None,
     "Totals of ratio measures are ratios of totals, not averages of member ratios."),
    ("stat.ratio_stability", "Daily ratio outside its usual band", "stat", "ratios", "medium", None,
     "The daily ratio stays within its historical band and hard bounds, except on explained days."),
    ("stat.weekday_robust_band", "Daily value outside its weekday band", "stat", "time", "medium", None,
     "Daily values sit within the weekday-adjusted band; flagged days are explained from the source."),
    ("stat.changepoints", "Level shift in the series", "stat", "time", "medium", None,
     "Level shifts in the series correspond to known business or tracking events."),
    ("stat.population_stability", "Category mix shifted", "stat", "mix", "medium", None,
     "The category mix shift between periods is explained; no category appears or disappears silently."),
    ("dax.campaign_window_alignment", "Events outside the campaign window", "dax", "campaign_time", "medium", "dax.assert",
     "No events are attributed to a campaign outside its active window, and every campaign with events has dates."),
    ("dax.campaign_name_churn", "Campaign renamed across sources", "dax", "campaign_time", "low", "dax.assert",
     "One campaign key has one name across the dimension and the facts that carry names."),
    ("dax.event_day_boundary", "Event dated on the wrong day (timezone)", "dax", "time", "medium", "dax.assert",
     "The date key of every event equals the calendar date of its timestamp in the reporting timezone "
     "(test with the source offset, e.g. UTC-4/-5 for Toronto)."),
    ("dax.future_or_negative_durations", "Negative durations or future events", "dax", "time", "medium", "dax.assert",
     "Durations are non-negative and no event is dated after the import watermark unless it is a scheduled future event by design."),
)

# component shape -> detectors that are the minimum for it
DETECTORS_BY_SHAPE = (
    ("count_by_date", ("stat.weekday_robust_band", "stat.changepoints", "dax.fan_out", "dax.additivity")),
    ("ratio_of_two_sources", ("stat.ratio_stability", "stat.ratio_of_totals_vs_mean_of_ratios")),
    ("members_with_total", ("dax.additivity", "stat.ratio_of_totals_vs_mean_of_ratios")),
    ("keyed_by_campaign", ("dax.campaign_window_alignment", "dax.campaign_name_churn", "stat.population_stability")),
    ("timestamp_and_date_key", ("dax.event_day_boundary",)),
    ("duration_or_future_start", ("dax.future_or_negative_durations",)),
    ("amount_under_date_slicer", ("lint.date_context_removed", "dax.assert")),
)

# --- metadata lint patterns ------------------------------------------------------
VOLATILE = r"(?i)(?U)\b(TODAY|NOW|UTCNOW|UTCTODAY)\s*\("
DATE_CONTEXT_REMOVAL = r"(?i)(?U)\b(REMOVEFILTERS|ALLSELECTED|ALLEXCEPT|ALL)\s*\(\s*'?(dim_date|date|calendar|dates|Date|Calendar)[^)]*\)"
FILTER_REMOVAL = r"(?i)(?U)\b(REMOVEFILTERS|ALLSELECTED|ALLEXCEPT|ALL)\s*\("
RAW_DIVISION = r"(\]|\))\s*/\s*(\[|\(|[A-Za-z])"
STATISTIC = r"(?i)(?U)\b(MEDIAN|MEDIANX|PERCENTILE\.INC|PERCENTILE\.EXC|PERCENTILEX\.INC|AVERAGE|AVERAGEX|DIVIDE)\s*\("
INTEGER_FORMAT = r'^\s*"?(#,##0|#,0|0)(?![.0-9])'
FRESHNESS_WORDS = r"(?i)refresh|updated|as of|last load|data through"
FRESHNESS_SOURCE = r"(?i)refresh|partition|NOW\(|UTCNOW"
ERROR_IDENTIFIER = "'[^'\\r\\n]{1,80}'|\"[^\"\\r\\n]{1,80}\""
PLACEHOLDER = r"<[A-Za-z_][A-Za-z0-9_]*>"
QUALIFIED_REFERENCE = r"(?:'([^'\r\n]+)'|(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*))\s*\[([^\]\r\n]+)\]"
BRACKETED = r"\[([^\]\r\n]+)\]"
DEFINED_MEASURE = r"(?i)\bMEASURE\s+(?:'[^'\r\n]+'|[A-Za-z_][A-Za-z0-9_]*)\s*\[([^\]\r\n]+)\]"
ALIAS = r'"([^"\r\n]*)"'
SOURCE_STEP = r'\[\s*Name\s*=\s*"([^"]+)"\s*,\s*Kind\s*=\s*"(%s)"\s*\]'
SOURCE_CONNECTOR = r"([A-Za-z][A-Za-z0-9]*)\.[A-Za-z][A-Za-z0-9]*\s*\("
NATIVE_QUERY = r"(?i)Value\.NativeQuery\s*\("
# Connector names and visual types as a reader would say them.
CONNECTOR_WORDS = {
    "GoogleBigQuery": "Google BigQuery", "Sql": "SQL Server", "AmazonRedshift": "Amazon Redshift", "Snowflake": "Snowflake",
    "PostgreSQL": "PostgreSQL", "MySQL": "MySQL", "Oracle": "Oracle", "Excel": "an Excel workbook", "Csv": "a CSV file",
    "Databricks": "Databricks", "AzureStorage": "Azure Storage", "Web": "a web source", "Odbc": "an ODBC source"}
VISUAL_TYPES = {
    "card": "card", "cardVisual": "card", "multiRowCard": "multi-row card", "kpi": "KPI", "tableEx": "table", "table": "table",
    "pivotTable": "matrix", "matrix": "matrix", "slicer": "slicer", "advancedSlicerVisual": "slicer", "textbox": "text box",
    "image": "image", "shape": "shape", "basicShape": "shape", "actionButton": "button", "group": "group of visuals",
    "lineChart": "line chart", "areaChart": "area chart", "stackedAreaChart": "stacked area chart", "columnChart": "column chart",
    "clusteredColumnChart": "column chart", "stackedColumnChart": "stacked column chart",
    "hundredPercentStackedColumnChart": "100% stacked column chart", "barChart": "bar chart", "clusteredBarChart": "bar chart",
    "stackedBarChart": "stacked bar chart", "hundredPercentStackedBarChart": "100% stacked bar chart",
    "lineClusteredColumnComboChart": "line and column combo chart", "lineStackedColumnComboChart": "line and stacked column combo chart",
    "pieChart": "pie chart", "donutChart": "donut chart", "treemap": "treemap", "funnel": "funnel", "gauge": "gauge",
    "waterfallChart": "waterfall chart", "scatterChart": "scatter chart", "map": "map", "filledMap": "filled map",
    "shapeMap": "shape map", "azureMap": "map", "ribbonChart": "ribbon chart", "decompositionTreeVisual": "decomposition tree",
    "keyDriversVisual": "key influencers", "qnaVisual": "Q&A visual", "esriVisual": "map", "scriptVisual": "script visual",
    "pythonVisual": "Python visual"}

# --- redaction patterns, in the order they are applied ------------------------------
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
GUID = r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
URL = r"(?U)\bhttps?://[^\s)\]}>\"'`]+"
WINDOWS_USER_PATH = r"(?U)[A-Za-z]:[\\/]+Users[\\/]+[^\\/\s\"'`<>|]+(?:[\\/]+[^\s\"'`<>|]*)*"
POSIX_USER_PATH = r"(?U)/(?:home|Users)/[^/\s\"'`<>|]+(?:/[^\s\"'`<>|]*)*"
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
PHONE = r"(?U)(?<![\w.\-])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)|\d{3})[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])"
ALLOWED_URL_HOSTS = ("docs.microsoft.com", "learn.microsoft.com")

# --- residual scan -----------------------------------------------------------------
CAPITALISED = r"(?U)\b[A-Z][A-Za-z0-9]+(?:[ \-][A-Z][A-Za-z0-9]+)+\b"
CURRENCY = r"(?U)[$€£¥]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s?(?:USD|EUR|GBP|CAD|AUD|ILS|CHF)\b"
BIG_NUMBER = r"(?U)\b\d{1,3}(?:,\d{3})+\b|\b\d{5,}\b"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
COMMON_CAPITALISED = tuple("""
power bi desktop service google ads meta ga4 bigquery dbt dax
analytics qa sql duckdb clickhouse postgres snowflake excel sharepoint
crm salesforce hubspot data model measure table column report page
visual card slicer chart filter context summary issues found open
questions detection methods design rules date time intelligence zone
campaign conversion rate attribution window lead leads spend cost
claude code python windows linux json csv parquet api mcp git
github readme skill plugin knowledge base article review sign off
the this that these those a an and or but if when while
for in on at of to by with from into over under after
before it we you they do does use used using add keep each
every not no yes one two three first last next same other
monday tuesday wednesday thursday friday saturday sunday
january february march april may june july august september
october november december utc iso id ids url uri http https
webview html css dom blank import mode custom visuals template
forecast median percentile mtd ytd refresh last run adding total
totals row rows value values step steps plan receipt receipts
""".split())

# --- search ------------------------------------------------------------------------
STOPWORDS = tuple("""
the and for are but not you all any can had her was one
our out day get has him his how man new now old see two
way who boy did its let put say she too use with that
this from have were been they them then than when what will
your each into more most some such only over very also just
like make made does done here there these those which while
would could should about after before because every other their
""".split())
STEM_SUFFIXES = (("ing", 6), ("ed", 5), ("es", 5), ("s", 4))
FIELD_WEIGHTS = {"title": 3, "summary": 2, "labels": 3, "body": 1}
TOPICS = tuple("""
data-model fan-out-joins dax-time-intelligence ratios-and-averages conversion-rate attribution meta-ads google-ads ga4
crm-vs-platform reporting-gaps timezone-day-boundary campaign-windows freshness-and-clock slicers-and-interactions
statistical-detection qa-process bi-acceleration power-bi-desktop-automation bigquery dbt regression-testing
sign-off-and-governance headless-agents visual-rendering
""".split())

# --- wording an analyst should not have to read ---------------------------------------
DAX_FUNCTIONS = tuple("""
COUNTROWS COUNT COUNTA COUNTAX COUNTBLANK CALCULATE CALCULATETABLE DIVIDE SUM SUMX AVERAGE AVERAGEX
MIN MINX MAX MAXX MEDIAN MEDIANX PERCENTILE.INC PERCENTILE.EXC FILTER ALL ALLEXCEPT ALLSELECTED
REMOVEFILTERS KEEPFILTERS VALUES DISTINCT DISTINCTCOUNT RELATED RELATEDTABLE USERELATIONSHIP EVALUATE
ROW SUMMARIZE SUMMARIZECOLUMNS ADDCOLUMNS SELECTCOLUMNS TODAY NOW DATE DATEADD DATESMTD DATESYTD
DATESQTD TOTALYTD TOTALMTD TOTALQTD SAMEPERIODLASTYEAR IF SWITCH BLANK ISBLANK VAR RETURN EARLIER
RANKX TOPN UNION EXCEPT INTERSECT CONCATENATEX FORMAT LOOKUPVALUE HASONEVALUE SELECTEDVALUE
ISFILTERED ISCROSSFILTERED
""".split())
TECHNICAL_PATTERNS = (
    r"(?U)\b(" + "|".join(name.replace(".", r"\.") for name in DAX_FUNCTIONS) + r")\b(?=\s*\(|\s*$|[\s,.;:)])",
    r"(?U)\b([A-Z][A-Z0-9_.]{3,})\s*\(",
    r"(?U)('[^']+'\s*\[[^\]]+\])",
    r"(\[[A-Za-z_][^\]]*\])",
    r"(?U)\b((?:fact|dim|stg|int)_\w+)",
    r"(?U)\b([A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+)\b",
    r"(?U)\b(DAX|TMSCHEMA|DOM)\b",
    r"(?i)(?U)\b(oracle|oracles|receipt|receipts|pointer|pointers|JSON pointer|M query)\b",
    r"(BLANK\(\)|role=|aria-[a-z]+)",
    r"(?U)([A-Za-z]:[\\/][^\s]*)",
    r"(?i)(?U)(\S+\.(?:json|py|html|png|csv|sql|pbix|pbip|bim|tmdl|yml))\b",
    r"(?U)\b((?:evidence|scripts|plugin|cases|procedures)[\\/][^\s]*)",
)
OBSERVED_COMPARISON = r"(?is)^observed\s+(.+?)\s*(==|!=|<=|>=|<|>)\s*expected\s+([^:]+?)\s*(?::\s*(.*))?$"
NUMBER_IN_TEXT = r"(?U)-?\d[\d,]*(?:\.\d+)?"
CLAUSE_END = r"(?U);|\s[—–-]\s|(?<=[.!?])\s+"

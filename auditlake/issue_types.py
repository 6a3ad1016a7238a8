"""The issue-type dimension: 79 rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Code, type and priority (1 critical, 2 alert, 3 warning), as users of the audit know them.
ISSUE_TYPES = """
1 ERROR_30x 1
2 ERROR_40x 1
3 ERROR_50x 1
4 ERROR_DUPLICATED_TITLE 2
5 ERROR_DUPLICATED_DESCRIPTION 2
6 ERROR_EMPTY_TITLE 2
7 ERROR_SHORT_TITLE 2
8 ERROR_LONG_TITLE 2
9 ERROR_EMPTY_DESCRIPTION 2
10 ERROR_SHORT_DESCRIPTION 2
11 ERROR_LONG_DESCRIPTION 2
12 ERROR_LITTLE_CONTENT 3
13 ERROR_IMAGES_NO_ALT 2
14 ERROR_REDIRECT_CHAIN 1
15 ERROR_NO_H1 2
16 ERROR_NO_LANG 3
17 ERROR_HTTP_LINKS 2
18 ERROR_HREFLANG_RETURN 2
19 ERROR_TOO_MANY_LINKS 3
20 ERROR_INTERNAL_NOFOLLOW 3
21 ERROR_EXTERNAL_WITHOUT_NOFOLLOW 3
22 ERROR_CANONICALIZED_NON_CANONICAL 2
23 ERROR_REDIRECT_LOOP 1
24 ERROR_NOT_VALID_HEADINGS 2
25 ERROR_HREFLANG_TO_NON_CANONICAL 2
26 ERROR_NOFOLLOW_INDEXABLE 2
27 ERROR_NO_INDEXABLE 3
28 ERROR_HREFLANG_NO_INDEXABLE 3
29 ERROR_BLOCKED 3
30 ERROR_ORPHAN 3
31 NO_INDEX_IN_SITEMAP 2
32 BLOCKED_IN_SITEMAP 2
33 NON_CANONICAL_IN_SITEMAP 2
34 INCOMING_FOLLOW_NOFOLLOW 2
35 INVALID_LANG 2
36 HTTP_SCHEME 1
37 DEAD_END 3
38 ERROR_CANONICALIZED_NON_INDEXABLE 3
39 ERROR_HREFLANG_REDIRECT 2
40 ERROR_CANONICAL_REDIRECT 2
41 ERROR_HREFLANG_ERROR 2
42 ERROR_CANONICAL_ERROR 2
43 ERROR_MULTIPLE_CANONICAL_TAGS 2
44 ERROR_RELATIVE_CANONICAL_URL 2
45 ERROR_HREFLANG_XDEFAULT 2
46 ERROR_HREFLANG_SELF_REFERENCE 2
47 ERROR_HREFLANG_MISMATCHING_LANG 2
48 ERROR_HREFLANG_RELATIVE_URL 2
49 ERROR_CANONICAL_MISMATCH 2
50 ERROR_MISSING_HSTS 3
51 ERROR_MISSING_CSP 3
52 ERROR_CONTENT_TYPE_OPTIONS 3
53 ERROR_LARGE_IMAGE 3
54 ERROR_LONG_ALT_TEXT 2
55 ERROR_MULTIPLE_TITLES 2
56 ERROR_MULTIPLE_DESCRIPTIONS 2
57 ERROR_PAGE_DEPTH 3
58 ERROR_MULTIPLE_LANG_REFERENCE 2
59 ERROR_DUPLICATED_CONTENT 2
60 ERROR_EXTERNAL_LINK_REDIRECT 3
61 ERROR_EXTERNAL_LINK_BROKEN 3
62 ERROR_TIMEOUT 1
63 ERROR_UNDERSCORE_URL 3
64 ERROR_SLOW_TTFB 2
65 ERROR_HTTP_FORM 2
66 ERROR_INSECURE_FORM 2
67 ERROR_SPACE_URL 2
68 ERROR_MULTIPLE_SLASHES 2
69 ERROR_NOIMAGEINDEX 3
70 ERROR_PICTURE_MISSONG_IMG 2
71 ERROR_METAS_IN_BODY 2
72 ERROR_NOSNIPPET 3
73 ERROR_IMG_SIZE_ATTR 3
74 ERROR_INCORRECT_MEDIA_TYPE 3
75 ERROR_DUPLICATED_ID 3
76 ERROR_MISSING_VIEWPORT 3
77 ERROR_DOM_SIZE 3
78 ERROR_PAGINATION_LINKS 2
79 ERROR_LOCALHOST_LINKS 2
"""
ROWS = [(int(code), name, int(priority)) for code, name, priority in map(str.split, ISSUE_TYPES.strip().splitlines())]
NAMES = {code: name for code, name, _ in ROWS}


def issue_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, "issue_type_id int, type string, priority int")

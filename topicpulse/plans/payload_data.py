"""Sample payload texts built from the sample tables, in SQL both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.plans.adapters_sql import register_cte
from topicpulse.sources.tables import SampleStore

K = "CAST(p_partkey AS STRING)"


def pick(divisor: int, *choices: str) -> str:
    """One of ``choices`` by part key."""
    arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices[:-1]))
    return f"CASE p_partkey % {divisor} {arms} ELSE {choices[-1]} END"


_KR36_ITEM = f"""concat('{{', {pick(3, f"concat('\"itemId\":', {K})", f"concat('\"itemId\":\"\",\"id\":\"', {K}, '\"')", f"concat('\"itemId\":0,\"articleId\":\"', {K}, '\"')")},
 ',"title":"', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(' ', p_name) END, '","widgetTitle":"', CASE WHEN p_partkey % 14 = 0 THEN '' ELSE concat(p_name, ' w') END, '"',
 {pick(4, f"concat(',\"url\":\"https://www.36kr.com/p/', {K}, '\"')", f"concat(',\"url\":\"/p/', {K}, '\"')", "',\"url\":\"odd\"'", "''")},
 {pick(5, "concat(',\"publishTime\":', CAST(1700000000000 + p_partkey * 1000 AS STRING))", "',\"publishTime\":\"2024-01-02 03:04\"'", "',\"publishTime\":0,\"formatDate\":\"3 days ago\"'", "concat(',\"publicTime\":', CAST(1600000000000 + p_partkey * 7000 AS STRING))", "''")},
 {pick(4, "',\"authorName\":\"ann\",\"author\":{\"name\":\"bob\"}'", "',\"author\":{\"name\":\"bob\"}'", "',\"author\":\"carl\"'", "',\"authorName\":\"dora\"'")},
 ',"viewCount":', CAST(p_size AS STRING), ',"likeCount":"', CAST(p_size AS STRING), '","commentCount":null,"summary":"', p_type, '"}}')"""

PAYLOADS: dict[str, str] = {
    "kr36": f"""concat('{{"data":', {pick(3, "'{\"hotRankList\":['", "'{\"hotRankList\":[],\"data\":{\"hotRankList\":['", "'{\"itemList\":[{\"templateMaterial\":'")},
      {_KR36_ITEM}, {pick(3, "']}}'", "']}}}'", "'}]}}'")})""",
    "huxiu": f"""concat('{{"data":', {pick(3, "'{\"datalist\":['", "'{\"data\":['", "'['")},
      '{{', {pick(3, f"concat('\"aid\":', {K})", f"concat('\"article_id\":\"', {K}, '\"')", f"concat('\"aid\":null,\"id\":', {K})")},
      ',"title":"', CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name END, '"',
      {pick(4, "',\"url\":\"/article/9.html\"'", "',\"url\":\"http://h/x\"'", "',\"url\":\"odd\"'", "''")},
      {pick(3, "concat(',\"publish_time\":', CAST(1700000000 + p_partkey AS STRING))", "',\"formatDate\":\"yesterday\"'", "concat(',\"dateline\":', CAST(1500000000 + p_partkey * 60 AS STRING))")},
      {pick(4, "',\"author\":{\"username\":\"ann\",\"name\":\"x\"}'", "',\"author\":{\"username\":\"\",\"name\":\"bob\"}'", "',\"author\":\"carl\"'", "',\"user_info\":{\"username\":\"dora\"}'")},
      ',"view_count":', CAST(p_size * 3 AS STRING), {pick(2, "concat(',\"summary\":\"', p_type, '\"')", "concat(',\"description\":\"', p_brand, '\"')")}, '}}', {pick(3, "']}}'", "']}}'", "']}'")})""",
    "zhihu": f"""concat('{{"data":[{{"target":', {pick(3,
      f"concat('{{\"type\":\"question\",\"id\":', {K}, ',\"title\":\"', p_name, '\",\"visit_count\":', CAST(p_size AS STRING), ',\"comment_count\":3}}')",
      f"concat('{{\"type\":\"answer\",\"id\":', {K}, ',\"voteup_count\":', CAST(p_size * 5 AS STRING), ',\"created_time\":', CAST(1700000000 + p_partkey AS STRING), ',\"author\":{{\"name\":\"ann\"}},\"question\":{{\"id\":7', {K}, ',\"title\":\"', p_name, ' q\",\"visit_count\":9}}}}')",
      f"concat('{{\"type\":\"article\",\"id\":\"', {K}, '\",\"title\":\"', p_name, ' a\",\"url\":\"http://z/', {K}, '\",\"voteup_count\":', CAST(p_size * 4 AS STRING), ',\"created_time\":\"bad\"}}')")}, '}}]}}')""",
    "juejin": f"""concat('{{"data":[{{"article_info":{{"article_id":"', CASE WHEN p_partkey % 8 = 0 THEN '' ELSE {K} END, '","title":"', p_name,
      '","view_count":', CAST(p_size AS STRING), ',"digg_count":2,"comment_count":"3","collect_count":', CAST(p_size % 7 AS STRING), ',"ctime":"', CAST(1700000000 + p_partkey * 60 AS STRING),
      '"}},"author_user_info":{{"user_name":"', p_brand, '"}}}},{{"article_info":{{}}}}]}}')""",
    "toutiao": f"""concat('{{"data":[{{"title":" ', p_name, ' ",', {pick(3, f"concat('\"article_url\":\"/i/', {K}, '\"')", f"concat('\"article_url\":\"\",\"url\":\"http://t/', {K}, '\"')", "'\"x\":1'")},
      {pick(4, f"concat(',\"group_id\":', {K})", f"concat(',\"item_id\":\"', {K}, '\"')", "',\"group_id\":0'", "''")},
      {pick(3, "concat(',\"publish_time\":\"', CAST(1700000000 + p_partkey AS STRING), '\"')", "concat(',\"behot_time\":', CAST(1600000000 + p_partkey AS STRING))", "',\"publish_time\":\"soon\"'")},
      ',"media_name":"', p_brand, '","read_count":', CAST(p_size AS STRING), ',"like_count":null}},{{"title":""}}]}}')""",
    "bilibili": f"""concat('{{"data":{{"result":[{{"id":', {K}, ',"title":"a <em class=k>', p_name, '</em> b","author":"', p_brand, '","view":', CAST(p_size AS STRING),
      ',"like":4,"reply":2,"coin":', CAST(p_size % 5 AS STRING), ',"pub_date":"2024-01-0', CAST(1 + p_partkey % 9 AS STRING), '"}},{{"id":""}}]}}}}')""",
    "xiaohongshu": f"""concat('{{"data":{{"items":[{{"id":"n', {K}, '","note_card":{{"display_title":"', p_name, '","user":{{"nickname":"', p_brand, '"}},"time":"t', {K},
      '","interact_info":{{"liked_count":"', CAST(p_size AS STRING), '","comment_count":1,"collected_count":"', CAST(p_size % 4 AS STRING), '"}}}}}},{{"note_card":{{}}}}]}}}}')""",
    "maimai": f"""concat('{{"data":{{"feeds":[{{"id":', {K}, ',"text":"', {pick(4, "concat(p_name, ' ', p_brand, chr(92), 'nsecond line')", "concat('<b>', p_name, '</b> x')", "''", "concat('  ', p_name, '  ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name)")},
      '"', {pick(2, "concat(',\"user\":{\"name\":\"', p_type, '\"}')", "''")}, ',"likes":', CAST(p_size AS STRING), ',"comment_count":2,"created_at":', CAST(1700000000 + p_partkey AS STRING), '}}]}}}}')""",
}

COMMENTS: dict[str, str] = {
    "kr36": f"""concat('{{"data":{{"data":{{"commentList":[{{"authorName":"a', {K}, '","content":"', p_name, '","likeCount":', CAST(p_size AS STRING), '}},{{"author":{{"name":"n"}},"content":"c2"}}]}}}}}}')""",
    "huxiu": f"""concat('{{"data":', {pick(2, "'{\"data\":['", "'['")}, '{{"username":"', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'ann' END, '","user":{{"username":null,"nick_name":"nick"}},"content":"', p_name, '","like_count":', CAST(p_size AS STRING), '}}', {pick(2, "']}}'", "']}'")})""",
    "zhihu": f"""concat('{{"data":[{{"author":{{"member":{{', CASE WHEN p_partkey % 2 = 0 THEN '"name":"zed"' ELSE '' END, '}}}},"content":"', p_name, '","like_count":', CAST(p_size AS STRING), '}}]}}')""",
    "juejin": f"""concat('{{"data":[{{"comment_info":{{"comment_content":"', p_name, '","digg_count":', CAST(p_size AS STRING), '}},"user_info":{{', CASE WHEN p_partkey % 2 = 0 THEN '"user_name":"jo"' ELSE '' END, '}}}}]}}')""",
    "toutiao": f"""concat('{{"message":"', CASE WHEN p_partkey % 4 = 0 THEN 'error' ELSE 'success' END, '","data":{{"comments":[{{"user":{{"name":"t"}},"text":"', p_name, '","digg_count":', CAST(p_size AS STRING), '}}]}}}}')""",
    "bilibili": f"""concat('{{"code":', CASE WHEN p_partkey % 4 = 1 THEN '-1' ELSE '0' END, ',"data":{{"replies":[{{"member":{{"uname":"b"}},"content":{{"message":"', p_name, '"}},"like":', CAST(p_size AS STRING), '}}]}}}}')""",
    "xiaohongshu": f"""concat('{{"data":{{"comments":[{{"user_info":{{"nickname":"x"}},"content":"', p_name, '","like_count":"', CAST(p_size AS STRING), '"}}]}}}}')""",
    "maimai": f"""concat('{{"data":{{"comments":[{{"user":{{}},"text":"<i>', p_name, '</i>  !","likes":', CAST(p_size AS STRING), '}},{{"text":""}}]}}}}')""",
}

for _name, _sql in PAYLOADS.items():
    register_cte(f"payload_{_name}", f"SELECT p_partkey AS payload_id, {_sql} AS payload FROM part")
for _name, _sql in COMMENTS.items():
    register_cte(f"comments_{_name}", f"SELECT p_partkey AS payload_id, {_sql} AS payload FROM part")


def payloads(s: SampleStore, platform: str) -> DataFrame:
    return s.spread("part", "p_partkey").select(F.col("p_partkey").alias("payload_id"), F.expr(PAYLOADS[platform]).alias("payload"))


def comments(s: SampleStore, platform: str) -> DataFrame:
    return s.spread("part", "p_partkey").select(F.col("p_partkey").alias("payload_id"), F.expr(COMMENTS[platform]).alias("payload"))

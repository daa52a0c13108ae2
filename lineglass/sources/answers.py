"""Model answers that already exist as response bodies."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_text(responses: DataFrame) -> DataFrame:
    """``(response_id, provider, body)`` -> ``(response_id, provider, text)``.

    Each provider wraps the text differently; the local one may leave it out.
    """
    body = F.col("body")
    text = (
        F.when(F.col("provider") == "anthropic", F.get_json_object(body, "$.content[0].text"))
        .when(F.col("provider") == "openai", F.get_json_object(body, "$.choices[0].message.content"))
        .when(F.col("provider") == "ollama", F.coalesce(F.get_json_object(body, "$.response"), F.lit("")))
    )
    return responses.select("response_id", "provider", text.alias("text"))

"""tillpoint: retail invoice analytics and weekly demand forecasting on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
``pyspark.sql`` expressions; the only driver-side values are the handful of
forecast origins and the fitted tree models.
"""

from tillpoint.session import get_session

__all__ = ["get_session"]

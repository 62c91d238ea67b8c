"""Schemas of messages and tables. Names, types and order are those of the known tables and messages."""

#: The row of a message log.
LOG_ROW = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"
EMPLOYEE = "employee_id bigint, age int, start_date timestamp, team string, role string, address string, name string"
CHANGELOG = "operation string, account_id bigint, balance bigint, last_updated timestamp"
MIRROR = "account_id bigint, balance float, last_updated timestamp"
#: A mirror that knows each key's last change, deletions included, whole enough to compare it with any other.
ORDERED_MIRROR = "account_id bigint, balance bigint, last_updated timestamp, operation string"
#: Fields of an Avro employee record, in wire order; start_date is epoch milliseconds.
AVRO_EMPLOYEE = [("employee_id", "long"), ("age", "int"), ("start_date", "long"), ("team", "string"), ("role", "string"), ("address", "string"), ("name", "string")]
JSON_EMPLOYEE = "employeeId int, name string"
EMPLOYEE_SPEC = ["hours(start_date)", "identity(team)", "bucket(8, employee_id)"]
CHANGELOG_SPEC = ["days(last_updated)", "bucket(8, account_id)"]
MIRROR_SPEC = ["bucket(8, account_id)"]

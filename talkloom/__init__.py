"""talkloom: conversational-data analytics as DataFrame and Column functions on Spark."""

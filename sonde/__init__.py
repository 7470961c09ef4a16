"""sonde: message-intelligence and exposure analytics on PySpark."""

"""Fixed values.

Data files, tables and messages have to carry exactly these, so they are kept
together and written out plainly. Nothing here is logic.
"""

# Product catalogue, category -> base product names.
CATALOGUE = {
    "Electronics": [
        "Mobile Phone", "Laptop", "Tablet", "Smart Watch", "Headphones",
        "Bluetooth Speaker", "Power Bank", "Keyboard", "Mouse", "Monitor",
        "Printer", "Router", "Webcam", "External Hard Drive", "USB Flash Drive",
        "Gaming Console", "Graphics Card", "Motherboard", "RAM", "SSD",
        "Soundbar", "Projector", "VR Headset", "Drone", "Digital Camera",
    ],
    "Clothing": [
        "T-Shirt", "Shirt", "Jeans", "Trousers", "Jacket", "Sweatshirt",
        "Kurta", "Kurti", "Saree", "Lehenga", "Blazer", "Shorts",
        "Skirt", "Top", "Track Pants", "Hoodie", "Cap", "Socks",
        "Raincoat", "Sweater", "Innerwear", "Nightwear",
    ],
    "Home": [
        "Mixer Grinder", "Washing Machine", "Refrigerator", "Microwave Oven",
        "Induction Cooktop", "Electric Kettle", "Iron", "Water Purifier",
        "Vacuum Cleaner", "Air Cooler", "Table Fan", "Ceiling Fan",
        "Lamp", "Curtains", "Bedsheet", "Pillow", "Mattress",
        "Dining Table", "Chair", "Sofa", "Wardrobe", "Bookshelf",
        "Wall Clock", "Door Mat",
    ],
    "Books": [
        "Novel", "Textbook", "Biography", "Comics", "Magazine",
        "Exam Guide", "Question Bank", "Notebook", "Diary",
        "Self Help Book", "Story Book", "Children Book",
        "Engineering Book", "Medical Book", "Law Book",
        "Maths Book", "Science Book", "History Book",
    ],
    "Beauty": [
        "Face Wash", "Face Cream", "Moisturizer", "Sunscreen", "Serum",
        "Perfume", "Deodorant", "Lipstick", "Foundation", "Compact Powder",
        "Hair Oil", "Shampoo", "Conditioner", "Hair Mask",
        "Beard Oil", "Trimmer", "Face Razor", "Hair Dryer",
        "Straightener", "Body Lotion",
    ],
    "Sports": [
        "Cricket Bat", "Cricket Ball", "Football", "Volleyball",
        "Badminton Racket", "Shuttlecock", "Tennis Racket",
        "Basketball", "Yoga Mat", "Skipping Rope", "Dumbbells",
        "Resistance Band", "Treadmill", "Gym Gloves", "Sports Shoes",
        "Helmet", "Knee Guard", "Cycling Gloves",
    ],
}

# Dimension sizes and the first number of each id series.
VARIANTS_PER_PRODUCT = 5
CUSTOMERS = 50_000
FIRST_PRODUCT_NUMBER = 100_000
FIRST_CUSTOMER_NUMBER = 100_000
LAST_ORDER_NUMBER = 197_681

# Id prefixes and the least number of digits in an order id.
ORDER_PREFIX = "ORD"
PRODUCT_PREFIX = "PROD"
CUSTOMER_PREFIX = "CUST"
ORDER_DIGITS = 9

# How a generated day is drawn.
DAY_ROWS = (5000, 7000)
QUANTITY = (1, 5)
PRICE_CENTS = (15_000, 8_000_000)
PAYMENT_TYPES = ["UPI", "Credit Card", "Debit Card", "Net Banking", "Cash on Delivery"]

# Columns a raw file must have, in file order.
REQUIRED_COLUMNS = [
    "order_id", "order_date", "customer_id", "customer_name", "product_id",
    "product_name", "category", "quantity", "price", "city", "payment_type",
]

# Metadata stamped at ingestion, and the landed file's path.
SOURCE_SYSTEM = "local_csv"
RAW_FILE = "sales_raw.csv"
DATE_FORMAT = "yyyy-MM-dd"

# Price buckets, upper bound exclusive; anything else is HIGH.
BUCKET_BOUNDS = [(500, "LOW"), (2000, "MEDIUM")]
TOP_BUCKET = "HIGH"

# Ingest failure messages.
INGEST_MESSAGES = {
    "non_empty": "CSV file is empty",
    "required_columns": "Missing columns",
    "order_id_not_null": "order_id contains NULL values",
    "quantity_positive": "quantity must be greater than 0",
    "price_positive": "price must be greater than 0",
}

# Data-quality failure messages.
QUALITY_MESSAGES = {
    "records_present": "No records found for given date",
    "order_id_not_null": "order_id contains NULL values",
    "quantity_positive": "quantity must be > 0",
    "price_positive": "price must be > 0",
    "total_amount_positive": "total_amount must be > 0",
}

# Publish target.
FACT_TABLE = "dbo.fact_sales"
JDBC_DRIVER = "com.microsoft.sqlserver.jdbc.SQLServerDriver"
JDBC_URL = (
    "jdbc:sqlserver://{server}:1433;database={database};encrypt=true;"
    "trustServerCertificate=false;loginTimeout=30;"
)
EMPTY_PUBLISH_MESSAGE = "No data found for SQL load"
PREVIEW_ROWS = 5
